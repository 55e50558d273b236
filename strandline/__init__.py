"""Analytics over evolving property graphs, on Spark DataFrames."""
