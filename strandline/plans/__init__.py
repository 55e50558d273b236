"""Complex reads, their SQL counterparts and the query catalogue."""
