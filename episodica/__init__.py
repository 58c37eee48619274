"""Spark-native analytics over typed interval events and their trajectories."""

__version__ = "0.1.0"
