"""Spark-native analytics for team-sport game logs."""
