"""Tidemark: point-process, interval and map analytics on PySpark."""
