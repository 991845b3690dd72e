"""Spark-native operators for recovering and analysing network topology at scale."""
