"""Training-data operators: formatting, sharding, tokens, packing, deduplication, PII, quality, secrets."""
