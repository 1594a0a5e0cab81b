"""Training-data operators: quality, language, duplication, privacy and encoding of texts."""
