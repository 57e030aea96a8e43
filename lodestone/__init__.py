"""Lodestone: a PySpark-native library of sequence, set, matrix and regression operators over DataFrames."""

__version__ = "0.1.0"
