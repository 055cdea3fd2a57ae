"""Training-data operators: dedup, mixing, tokenising, filtering, formatting and archives."""
