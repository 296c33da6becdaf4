"""quarrymill: a PySpark-native engine for preparing, validating, streaming and analysing model-training corpora."""

__version__ = "0.1.0"
