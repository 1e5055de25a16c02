"""Structured Streaming jobs. Each reuses its batch operator inside foreachBatch, so both give the same rows."""
