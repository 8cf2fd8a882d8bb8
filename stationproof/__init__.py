"""Sensor data trust on Spark: which readings of a station network can be believed."""

__version__ = "0.1.0"
