"""Operators over corpora and indexes: matching, counting, ranking, statistics, rare terms, relevance metrics."""
