"""Training-data operators: near-duplicates, decontamination, quality, packing and the like."""
