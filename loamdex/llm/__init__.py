"""Training-data operators: fingerprints, scans, token counts, near-duplicates, decontamination, sharding."""
