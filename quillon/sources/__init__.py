"""Where data come from and go to: corpora of texts, shared folders, index tables."""
