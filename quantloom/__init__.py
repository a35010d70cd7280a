"""Factor research on Spark: panels, factors, labels, scores, portfolios, evaluation."""
