"""factloom: a bitemporal fact store and ranked retrieval on Spark DataFrames.

``sources`` reads and checks the tables, ``functions`` holds column expressions,
``operators`` turns DataFrames into DataFrames, ``plans`` names the queries and
their SQL twins, ``streaming`` runs the stateful folds on Structured Streaming.
The subpackage ``llm`` (training-data preparation) is optional: nothing outside
it imports it.
"""
