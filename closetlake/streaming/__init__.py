"""Streaming forms of three batch operators over the call log."""
