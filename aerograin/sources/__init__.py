"""Readers, sensor-shaped views over the event table, generators, and sinks."""
