"""Joint analysis of several tables that describe overlapping sets of individuals, on Spark."""
