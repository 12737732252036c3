"""logloom: scripted traffic scenarios and seeded log fields for Spark DataFrames."""

__version__ = "0.1.0"
