"""Streams beyond what batches offer: new index rows are decided as they arrive."""
