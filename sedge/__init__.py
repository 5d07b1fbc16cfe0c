"""sedge: query and data-processing operators written as Spark DataFrame jobs."""

__version__ = "0.1.0"
