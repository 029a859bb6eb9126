"""Support-ticket analytics as Spark jobs: every operation maps DataFrames to DataFrames."""
