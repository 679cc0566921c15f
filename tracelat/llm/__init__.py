"""Training-data operators: quality rules, pseudonyms, secret scans, sharding, token files, packing,
fingerprints, near-duplicates, tokenizers' encoding and token counts.  Nothing else in the library imports this."""
