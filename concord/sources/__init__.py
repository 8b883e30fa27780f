"""Reading and writing tables, assays and fits."""
