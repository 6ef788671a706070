"""Operators of a training-data pipeline (quality model, mixing, token files,
line and document de-duplication, language-model scoring, search, licence
scans, forced-boundary BPE). Nothing else in the library imports this package."""
