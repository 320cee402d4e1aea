"""bindscape.plans."""
