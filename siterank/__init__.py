"""Site prioritization on Spark: spatial joins, clipped lines, scores and ranks as DataFrame jobs."""
