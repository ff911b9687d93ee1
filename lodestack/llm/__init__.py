"""Training-data operators: filters, scans, dedup, scoring, search and tokenizers."""
