"""Training-data operators: extraction, quality, deduplication, indexing and packing."""
