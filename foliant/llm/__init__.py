"""Training-data operators: fingerprints, packing, archives, deduplication, decontamination, extraction and scoring."""
