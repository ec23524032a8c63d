"""Operators, queries and SQL of the training-data pipeline; nothing else in the library imports them."""
