"""Analytics for competitive-event data, expressed as Spark DataFrames."""
