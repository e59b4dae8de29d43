"""Structured Streaming counterparts; over a replayed table they equal the batch queries."""
