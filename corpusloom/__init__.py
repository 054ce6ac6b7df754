"""corpusloom: document retrieval at corpus scale, as Spark DataFrame jobs."""

__version__ = "0.1.0"
