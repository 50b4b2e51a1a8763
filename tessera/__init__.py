"""A relational engine on Spark: its own SQL dialect, a versioned snapshot store and transactions."""
