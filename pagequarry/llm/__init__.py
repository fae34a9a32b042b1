"""Training-data operators: language, licences, secrets, duplicates, quality, mixing, privacy, tokens, search."""
