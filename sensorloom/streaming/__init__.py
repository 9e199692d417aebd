"""Streaming of the sensor-panel engine."""
