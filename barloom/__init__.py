"""Spark-native cross-sectional research engine for daily bar panels."""
