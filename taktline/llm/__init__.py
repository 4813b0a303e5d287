"""Operators for training-data pipelines on text; nothing outside this folder imports them."""
