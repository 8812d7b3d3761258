"""Training-data operators: packing, licences, quality, sharding, decontamination, deduplication, privacy and secrets."""
