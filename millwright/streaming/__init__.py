"""Streams of messages and events."""
