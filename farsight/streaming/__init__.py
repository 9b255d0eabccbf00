"""Structured Streaming forms of the dedupe, routing and failure-ratio operators."""
