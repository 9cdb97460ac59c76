"""Reading and writing grids, statistics and metric tables."""
