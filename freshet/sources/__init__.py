"""Readers, sinks and the logical input tables."""
