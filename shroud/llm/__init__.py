"""Training-data operators: deduplication, privacy, search, scoring, tokens and packing."""
