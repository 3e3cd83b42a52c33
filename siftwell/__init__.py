"""Content deduplication and data hygiene on Spark DataFrames."""
