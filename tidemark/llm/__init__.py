"""Training-data operators: packing, mixing, chat formatting, deduplication, archives, fingerprints and classifiers."""
