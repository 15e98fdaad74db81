"""Streaming counterparts of job handling."""
