"""Operators for preparing training text: packing, scans, language, scoring, storage and near duplicates."""
