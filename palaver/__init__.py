"""palaver: a PySpark-native engine for meeting transcripts and other ordered, multi-speaker text."""

__version__ = "0.1.0"
