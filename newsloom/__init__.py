"""News-monitoring analytics on Spark: functions from DataFrame to DataFrame."""

__version__ = "0.1.0"
