"""caseweave: Spark-native analytics over collections of case files."""
