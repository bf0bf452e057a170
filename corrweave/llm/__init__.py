"""Training-data operators: fingerprints, extraction, language, tokens, search, quality, PII, packing."""
