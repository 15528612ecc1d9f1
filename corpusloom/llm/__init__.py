"""Training-data operators: extraction, tokenizing, fingerprints, deduplication, archives, packing."""
