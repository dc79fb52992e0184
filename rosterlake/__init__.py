"""Data quality, lake ingestion and workforce analytics on Spark DataFrames."""
