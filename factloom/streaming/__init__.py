"""Stateful folds on Structured Streaming."""
