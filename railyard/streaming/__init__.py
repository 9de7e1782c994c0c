"""Structured Streaming forms of the job-status rules (change feed with
retention, missing-job feed) and their sinks."""
