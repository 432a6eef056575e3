"""Preparation of training text: ten operators, their queries and SQL."""
