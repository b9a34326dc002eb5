"""heliodor: a Spark-native transactional SQL engine and data-processing library."""
