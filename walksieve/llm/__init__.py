"""Operators for building training corpora: scans, archives, tokens, scores, near duplicates, filters, search, packing."""
