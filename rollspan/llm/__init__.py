"""Training-data operators: deduplication, scoring, tokens, packing, shards, search, archives."""
