"""Streams of snapshots."""
