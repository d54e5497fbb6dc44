"""Queue stages as Structured Streaming over JSON directories."""
