"""Column functions and worker-side helpers."""
