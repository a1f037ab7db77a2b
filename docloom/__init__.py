"""Document analytics on Spark: sources, framers, chunkers, enrichment, search, graph walks and evaluation."""
