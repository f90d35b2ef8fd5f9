"""Structured Streaming forms of the job-state operators."""
