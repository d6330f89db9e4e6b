"""A filesystem-metadata index and search engine written for Spark."""
