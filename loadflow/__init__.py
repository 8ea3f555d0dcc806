"""Batch jobs for load pipelines, as DataFrame code."""
