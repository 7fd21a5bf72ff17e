"""Sensor-signal analytics on Spark: windows, quality control, features, evaluation, lineage."""
