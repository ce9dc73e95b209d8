"""Spark-native research-paper triage engine."""
