"""Reusable column expressions and distributed ordered helpers."""
