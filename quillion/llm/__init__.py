"""Training-data operators: archives, deduplication, filtering, extraction, mixing."""
