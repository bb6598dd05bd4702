"""Operators for text corpora: quality, duplicates, personal data, tokens, packing, archives and mixing."""
