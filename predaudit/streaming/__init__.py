"""Metrics over time, batch and streaming."""
