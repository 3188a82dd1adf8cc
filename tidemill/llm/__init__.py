"""Training-data operators (packing, dedup, mixing, extraction, scoring ...)."""
