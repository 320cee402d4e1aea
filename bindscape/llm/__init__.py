"""Training-data operators: tokens, records, dedup, filters, scans. Nothing outside this subpackage imports it."""
