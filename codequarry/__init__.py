"""codequarry: code-knowledge extraction and retrieval as Spark DataFrame jobs."""
