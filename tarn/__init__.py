"""Representative data reduction and corpus preparation as Spark plans."""

__version__ = "0.1.0"
