"""Registry analytics on Spark: conforming, merging, as-of queries, graphs, validation and streams."""
