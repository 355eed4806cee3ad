"""Siltstone: a document-analytics engine written as PySpark DataFrame functions."""
