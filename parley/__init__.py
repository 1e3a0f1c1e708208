"""Analytics over time-stamped, speaker-attributed conversations, as Spark DataFrame transformations."""
