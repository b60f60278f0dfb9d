"""Spark-native ordered key-value analytics: a change log, its latest state, and the upkeep of sorted runs."""
