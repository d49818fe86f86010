"""Spark-native streaming prediction analytics: typed events, sketches, Hoeffding forests, running quality."""
