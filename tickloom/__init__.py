"""Market time-series on Spark: bars, indicators, feature tables, labels, back-tests and trade reports."""
