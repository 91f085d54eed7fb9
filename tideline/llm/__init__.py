"""Operators that prepare training corpora: mixing, deduplication, packing, filtering and scoring."""
