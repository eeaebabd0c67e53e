"""docuweave: a Spark-native document-graph analytics engine."""
