"""Training-data operators: dedup, language, privacy, secrets, tokens, lists, search, packing, quality."""
