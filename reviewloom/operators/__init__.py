"""DataFrame -> DataFrame operators, grouped by product."""
