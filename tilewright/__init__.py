"""Windowed-sensor and vector analytics expressed as Spark DataFrame plans."""
