"""Structured Streaming: prices as they come in, by ticker and day."""
