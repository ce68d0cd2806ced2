"""Training-data operators: dedup, sharding, filtering, counting, mixing, packing."""
