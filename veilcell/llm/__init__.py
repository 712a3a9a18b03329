"""Operators for preparing training text: duplicates, quality, language, privacy, extraction, tokens and mixing."""
