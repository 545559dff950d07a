"""Structured Streaming forms of the batch operators."""

from eventloom.streaming.jobs import drain, interval_counts, kill_groups, lifecycle_join, running_totals

__all__ = ["drain", "interval_counts", "kill_groups", "lifecycle_join", "running_totals"]
