"""terrawing: aerial-survey analytics as Spark DataFrames."""

__version__ = "0.1.0"
