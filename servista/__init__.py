"""servista: service-request analytics on Spark (staging, change history, gold aggregates, quality rules)."""
