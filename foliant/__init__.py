"""Structured document processing and training-data operators on PySpark."""
