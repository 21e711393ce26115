"""Clinical time-series analytics on Spark: DataFrame operators, sources, functions, plans and streams."""
