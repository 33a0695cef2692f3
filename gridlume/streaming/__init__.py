"""Structured Streaming twins of the batch folds."""
