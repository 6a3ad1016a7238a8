"""Site-audit analytics on Spark: pages, links and rules as DataFrames."""
