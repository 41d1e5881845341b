"""Named queries with their check SQL."""
