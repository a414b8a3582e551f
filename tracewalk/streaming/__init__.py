"""Idempotent upserts of nodes and edges from streams."""
