"""Sinks: queue messages, results history CSV, dead letters, changed assets."""
