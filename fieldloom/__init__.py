"""Analytics for gridded space-time fields on Spark."""
