"""bindscape.operators."""
