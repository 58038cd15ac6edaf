"""operators of the point-table engine."""
