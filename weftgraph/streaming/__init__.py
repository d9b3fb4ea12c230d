"""Streams of records into exactly-once runs."""
