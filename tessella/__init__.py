"""Spark-native analytics over sparse two-way ratings and typed knowledge graphs."""
