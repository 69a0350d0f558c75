"""Analytics for fleets of fixed smoke-detection cameras, as Spark DataFrame jobs."""
