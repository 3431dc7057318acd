"""Spark jobs for log anomaly detection data: DataFrame in, DataFrame out."""
