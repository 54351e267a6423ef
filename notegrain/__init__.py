"""Clinical concept analytics as Spark DataFrame plans."""

__version__ = "0.2.0"
