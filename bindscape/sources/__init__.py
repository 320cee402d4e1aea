"""bindscape.sources."""
