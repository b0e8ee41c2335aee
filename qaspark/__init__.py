"""Question/answer data generation from document tables, written as Spark DataFrame operators."""

__version__ = "0.1.0"
