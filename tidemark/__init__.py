"""Time-aware analytics on Spark: bitemporal tables, leakage-free features, probability tables, scoring."""
