"""Structured Streaming jobs (optional extension; the analysed tool has no streams)."""
