"""plans of the point-table engine."""
