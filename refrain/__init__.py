"""refrain: a PySpark-native engine for mining repetition in text and bytes."""

__version__ = "0.1.0"
