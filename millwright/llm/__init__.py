"""Training-data operators: dedup, quality, toxicity, packing, search, secrets and archives."""
