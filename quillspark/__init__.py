"""Corpus analytics on PySpark: declarative operators over DataFrames."""
