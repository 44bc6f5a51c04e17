"""cairn: dense-map analytics on Spark, keyed by Morton codes."""
