"""tidemill: staged, keyed line processing on Spark, in batch and as a stream."""
