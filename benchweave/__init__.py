"""Spark-native curation, splitting and retrieval evaluation of labelled two-modality datasets."""

__version__ = "0.1.0"
