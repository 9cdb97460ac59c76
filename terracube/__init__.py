"""Spark jobs for gridded time series: read, mask, scale, sample, cut, score."""
