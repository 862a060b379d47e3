"""pointweave: point-level event analytics as lazy Spark DataFrame plans."""
