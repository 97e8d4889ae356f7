"""Operators for preparing training text: one module each, on DataFrames of documents."""
