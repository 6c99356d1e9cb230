"""Text analytics and training-data preparation as Spark DataFrame transforms."""
