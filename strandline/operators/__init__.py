"""Plans over DataFrames: traversals, versioned reads, ingest."""
