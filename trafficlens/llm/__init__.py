"""Training-data operators: filtering, deduplication, tokenising, scoring, sharding and packing of text corpora."""
