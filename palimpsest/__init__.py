"""Analytics over catalogs of versioned definitions, on Spark DataFrames."""
