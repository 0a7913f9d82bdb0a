"""Streams of captured pages and marks."""
