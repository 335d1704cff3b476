"""Document ingestion and hybrid retrieval expressed as Spark jobs."""
