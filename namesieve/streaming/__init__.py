"""Structured Streaming forms of screening and the audit trail."""
