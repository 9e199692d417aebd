"""Operators of the sensor-panel engine."""
