"""Training-data operators: mixing, WARC, exact search, extraction, packing, scoring, dedup, scans, rules, shards."""
