"""veritab: table profiling, trust checks and baseline models as Spark DataFrame / MLlib jobs."""

__version__ = "0.1.0"
