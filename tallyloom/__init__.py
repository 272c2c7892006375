"""Agreement analytics, weak supervision and data preparation as Spark plans."""
