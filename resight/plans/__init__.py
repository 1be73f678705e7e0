"""Report tables and the queries registered for the driver tables."""
