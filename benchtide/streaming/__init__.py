"""Keyed stateful stream processors and availableNow jobs with idempotent sinks."""
