"""Panel causal analytics expressed as Spark DataFrame jobs."""
