"""Column builders over panels: time series, cross-sections, joins, statistics."""
