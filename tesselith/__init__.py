"""Corpus analytics on Spark: text ETL, labelling, splits, probes and their statistics as DataFrame plans."""

__version__ = "0.1.0"
