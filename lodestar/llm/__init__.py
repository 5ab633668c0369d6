"""Operators for training data: splitting, term statistics, deduplication, tokenising, leak search, language labels."""
