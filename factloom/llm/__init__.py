"""Training-data operators over free text and vectors.

Nothing outside this subpackage imports it; it may import the rest.
"""
