"""Registered queries and their comparison SQL."""
