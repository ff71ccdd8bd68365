"""Progressive, error-bounded analytics on numerical fields, as DataFrame jobs."""
