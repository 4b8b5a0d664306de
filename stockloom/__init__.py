"""Daily market panels as Spark DataFrames: sources, operators, plans and streams."""
