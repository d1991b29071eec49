"""Streaming forms of the append-only logs (beyond the batch operators)."""
