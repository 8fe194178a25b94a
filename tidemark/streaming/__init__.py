"""Structured Streaming: landing-file stream -> keyed, idempotent upsert."""
