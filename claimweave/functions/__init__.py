"""Scalar functions that Spark lacks."""
