"""Training-data operators: filters, near-duplicates, mixing, packing, extraction and archives."""
