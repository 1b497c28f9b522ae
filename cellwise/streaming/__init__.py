"""Streaming of cellwise."""
