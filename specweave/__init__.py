"""Hyperspectral analytics expressed as Spark DataFrame plans."""
