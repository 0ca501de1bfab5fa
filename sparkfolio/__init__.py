"""Part of sparkfolio, a Spark-native analytics engine for research corpora."""
