"""Market-bar analytics as Spark plans."""
