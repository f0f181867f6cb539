"""tidewatch: Spark-native analytics for drifting event streams."""

__version__ = "0.1.0"
