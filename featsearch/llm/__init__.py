"""Training-data operators: dedup, mixing, filtering, extraction, tokenising."""
