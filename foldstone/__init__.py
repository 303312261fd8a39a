"""Foldstone: versioned records, change feeds and vector retrieval as Spark plans.

Every operator takes DataFrames and returns DataFrames; nothing is collected to
the driver unless a docstring names its bound.
"""
