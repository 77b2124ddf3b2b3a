"""Training-data operators: tokenisation, packing, near-duplicates, scoring and archives."""
