"""Structured Streaming counterparts of algebraic aggregates (an extension of this engine)."""
