"""Training-data operators: dedup, decontamination, tokenisation, filters and archives."""
