"""Queries and the plans made of them: the query language, predicates over documents, plans over postings."""
