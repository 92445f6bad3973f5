"""Structured Streaming front end of the ledger."""
