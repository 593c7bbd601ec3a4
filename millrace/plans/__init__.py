"""millrace.plans."""
