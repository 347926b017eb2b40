"""End-to-end flows, table mappings and the query catalogue."""
