"""Fragment store, manifests and raw files."""
