"""Vector training data on Spark: prepare, feed, score, sample and summarise."""
