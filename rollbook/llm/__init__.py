"""Operators for training-data pipelines: extraction, language, duplicates, leaks, packing, licences."""
