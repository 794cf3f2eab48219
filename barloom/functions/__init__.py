"""Shared column and window helpers."""
