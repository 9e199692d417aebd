"""Sources of the sensor-panel engine."""
