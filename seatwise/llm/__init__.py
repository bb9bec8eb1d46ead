"""Training-data operators: scans, scoring, filtering, de-duplication, mixing, formatting, archives and packing."""
