"""pulseweave: event-stream analytics expressed as Spark DataFrame plans."""
