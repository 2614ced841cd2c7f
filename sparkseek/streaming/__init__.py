"""Keeping a store fresh from a stream of change records."""
