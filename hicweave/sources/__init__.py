"""Text sources and sinks, and views on the given tables."""
