"""Training-data operators: extraction, deduplication, tokenisation, scoring, search and privacy."""
