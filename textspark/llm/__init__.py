"""Training-data operators: deduplication, filtering, mixing, packing and archive I/O."""
