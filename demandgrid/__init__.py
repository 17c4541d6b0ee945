"""Demand analytics on PySpark: preparation, features, key selection,
training, evaluation and run comparison, all as DataFrame plans."""

__version__ = "0.1.0"
