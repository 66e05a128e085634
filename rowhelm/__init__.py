"""Data-quality profiling, drift comparison and daily anomaly detection on Spark."""

__version__ = "0.1.0"
