"""Readers: database dumps, zipped embedding shards, work items, lake tables."""
