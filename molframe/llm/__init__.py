"""Operators for training-corpus pipelines."""
