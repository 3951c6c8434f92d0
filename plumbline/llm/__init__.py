"""Training-data operators: filters, dedup, mixing, tokenisation."""
