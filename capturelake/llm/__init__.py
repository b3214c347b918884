"""Training-data operators: dedup, filtering, sharding, packing, mixing and binary output."""
