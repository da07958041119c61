"""Lectern: document retrieval and data preparation as plain PySpark DataFrame jobs."""
