"""Training-data operators: tokens, search, packing, fingerprints, filters, models."""
