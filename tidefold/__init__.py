"""tidefold: Spark-native audits of trial-based decoding benchmarks."""
