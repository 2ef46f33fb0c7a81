"""Lectern: document-library analytics expressed as DataFrame and Spark SQL plans."""
