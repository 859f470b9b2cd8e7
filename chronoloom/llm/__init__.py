"""Training-data operators: mixing, cleaning, deduplication and archives of text corpora."""
