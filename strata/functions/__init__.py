"""Column expressions: text rules, value rendering and calendar buckets."""
