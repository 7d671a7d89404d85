"""Multi-label document analytics expressed as Spark DataFrame jobs."""
