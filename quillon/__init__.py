"""A PySpark engine for lexical search over DataFrames."""
