"""Chaining of anchors that arrive over time."""
