"""Analytics for time-ordered event tables and object-position tables on Spark."""
