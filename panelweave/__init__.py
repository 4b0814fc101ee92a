"""Point-in-time equity research on Spark: sources, operators, plans, queries."""
