"""Training-data operators: quality, mixing, deduplication, archives, joins, scans, extraction, token codes."""
