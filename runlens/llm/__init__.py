"""Operators for preparing training data: filters, deduplication, token work and packing."""
