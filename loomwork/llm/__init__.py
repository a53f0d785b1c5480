"""Training-data operators: extraction, near-duplicates, search, tokens, archives and sharding."""
