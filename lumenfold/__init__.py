"""Imaging-spectroscopy analytics expressed as Spark DataFrame operations."""
