"""Page alignment and annotation at corpus scale, as PySpark DataFrame operators."""

__version__ = "0.1.0"
