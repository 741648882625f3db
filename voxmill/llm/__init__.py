"""Operators for preparing training data: scoring, filtering, deduplication, decontamination, formatting, mixing."""
