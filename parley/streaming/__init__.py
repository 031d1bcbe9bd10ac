"""Structured Streaming: stateful turn numbering, map-only scoring and
micro-batch turn processing."""
