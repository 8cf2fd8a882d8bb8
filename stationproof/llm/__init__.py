"""Operators for text corpora: decontamination, scoring, scans, tokenizing, nearest neighbours and deduplication."""
