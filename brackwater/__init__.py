"""Spark-native analytics engine: DataFrame operators, streaming twins and their query catalogue."""
