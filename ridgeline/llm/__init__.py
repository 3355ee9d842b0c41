"""Training-data operators: scans, dedup, decontamination, formatting, packing."""
