"""Chunkers: functions from a file's text to typed chunks, run on executors by ``quarry.operators.chunking``."""
