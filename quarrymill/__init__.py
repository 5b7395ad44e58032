"""quarrymill: a PySpark engine that turns untrusted tables into verified metrics."""

__version__ = "0.1.0"
