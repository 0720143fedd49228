"""Training-data operators: language ID, extraction, tokens, deduplication, search, packing, archives."""
