"""Operators for building training corpora: deduplication, filtering, scanning, packing."""
