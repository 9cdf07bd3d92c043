"""Training-data operators: scoring, filtering, deduplication, packing."""
