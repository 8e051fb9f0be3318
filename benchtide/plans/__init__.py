"""End-to-end chains built from the operators (batch and streaming)."""
