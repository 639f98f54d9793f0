"""evigraph: a Spark-native evidence-graph analytics engine."""
