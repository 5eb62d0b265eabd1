"""Column functions; see the modules."""
