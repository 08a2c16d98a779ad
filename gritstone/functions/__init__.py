"""Reusable SQL expressions."""
