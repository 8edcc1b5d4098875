"""Sinks: JSON, SARIF, quiet text, console text, key-partitioned memo tables."""
