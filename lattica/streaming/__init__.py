"""Asynchronous surfaces of a session, and streaming ingest."""
