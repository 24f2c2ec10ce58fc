"""Top-k recommendation analytics over a purchase log, as Spark jobs."""
