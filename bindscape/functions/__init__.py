"""bindscape.functions."""
