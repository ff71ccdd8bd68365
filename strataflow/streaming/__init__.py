"""Step streams and progressive state."""
