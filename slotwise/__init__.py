"""Intraday time-slot analytics on Spark: canonical bars, coverage, gates, measurements and rankings."""
