"""Readers and writers for ledgers, predictions, documents and logs."""
