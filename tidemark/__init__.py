"""Behaviour analytics on Spark: batch and streaming DataFrames behind one set of operators."""
