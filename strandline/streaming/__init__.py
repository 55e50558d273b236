"""Replay of update streams."""
