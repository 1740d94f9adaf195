"""Structured Streaming over raw arrivals."""
