"""Training-data operators: dedup, archives, privacy, packing, language, quality, decontamination."""
