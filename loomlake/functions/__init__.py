"""Column expressions: URIs, times, JSON values, cursors."""
