"""bindscape.streaming."""
