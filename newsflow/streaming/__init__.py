"""Structured Streaming jobs that run the batch operators per micro-batch."""
