"""Training-data operators: deduplication, classifiers, search, packing, mixing and binary token files."""
