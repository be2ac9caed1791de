"""Training-data operators on Spark: deduplication, archives, tokens, language, media, packing."""
