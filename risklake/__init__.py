"""risklake: code-risk analytics as PySpark DataFrame jobs."""
