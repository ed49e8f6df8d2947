"""Supply-chain exposure analytics as Spark DataFrame and streaming jobs."""
