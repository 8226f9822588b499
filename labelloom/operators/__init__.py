"""DataFrame operators: deduplication, splits, statistics, metrics, models."""
