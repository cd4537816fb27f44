"""Incremental refresh of facts, in batch and as a stream."""
