"""Panel analytics on Spark: entity-by-date bars, features, labels, selection, portfolios and studies."""
