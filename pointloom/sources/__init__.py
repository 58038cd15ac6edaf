"""sources of the point-table engine."""
