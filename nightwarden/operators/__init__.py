"""Reusable DataFrame operators (sliding counts, anchors, sessions, matches)."""
