"""Text search and session analytics expressed as Spark DataFrame jobs."""
