"""Structured Streaming form of the repair loop."""
