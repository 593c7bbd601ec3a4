"""millrace.operators."""
