"""weir: HTTP attack analytics and corpus operations as Spark DataFrame jobs."""
