"""Part of the index and search engine."""
