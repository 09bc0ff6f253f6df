"""Near-duplicate analytics and training-data preparation as PySpark plans."""
