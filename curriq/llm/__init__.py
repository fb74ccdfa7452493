"""Training-data operators: scoring, de-duplication, mixing, packing and search over text tables."""
