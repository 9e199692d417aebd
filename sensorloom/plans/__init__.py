"""Plans of the sensor-panel engine."""
