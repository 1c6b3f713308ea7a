"""rankwell: record matching, ranking and reconciliation on Spark DataFrames."""

__version__ = "0.1.0"
