"""Statistics and training-data operators on Spark."""
