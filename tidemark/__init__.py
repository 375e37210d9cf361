"""Tidemark: market time series and text-corpus curation as PySpark DataFrame operators."""
