"""Link extraction, relevance scoring and a link catalog, as Spark DataFrame jobs."""

__version__ = "0.1.0"
