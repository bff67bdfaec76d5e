"""Training-data operators: decontamination, deduplication, token output, packing,
sharding, extraction and quality scoring.  Nothing else in the library imports this."""
