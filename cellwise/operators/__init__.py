"""Operators of cellwise."""
