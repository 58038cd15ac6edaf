"""streaming of the point-table engine."""
