"""Treeline: Spark-native analytics over filesystem-style inventories."""
