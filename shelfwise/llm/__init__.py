"""Training-data operators: tokenisation, quality, deduplication, packing, media and output."""
