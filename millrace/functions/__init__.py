"""millrace.functions."""
