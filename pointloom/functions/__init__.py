"""functions of the point-table engine."""
