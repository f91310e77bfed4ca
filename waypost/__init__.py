"""Partner-network and lead-funnel analytics on Spark DataFrames."""
