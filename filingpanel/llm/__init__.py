"""Operators for training-data pipelines; queries and SQL texts are in ``queries``."""
