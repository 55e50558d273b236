"""Files, projections and shared tables."""
