"""sluice: governed SQL and training-data operators on Spark."""
