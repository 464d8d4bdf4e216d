"""Structured Streaming versions of the sensor roll-ups."""
