"""View compiler and the query catalogue."""
