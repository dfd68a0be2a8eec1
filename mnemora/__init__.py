"""Mnemora: memory analytics on PySpark DataFrames."""
