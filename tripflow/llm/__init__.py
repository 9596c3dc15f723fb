"""Training-data operators: licence scans, quality, deduplication, packing, decontamination, language, sharding."""
