"""Training-data operators: scoring, deduplication, scanning, packing, archiving."""
