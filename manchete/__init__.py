"""News-corpus analytics on Spark: capture tables, cleaning, counts and text statistics."""
