"""Training-data operators: deduplication, decontamination, filtering, mixing, sharding, archives."""
