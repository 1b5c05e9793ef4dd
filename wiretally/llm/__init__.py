"""Training-data operators: sharding, deduplication, packing, quality, extraction, decontamination, search, language."""
