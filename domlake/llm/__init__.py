"""Operators for training-data pipelines: near duplicates, classifiers, filters, scans, mixing."""
