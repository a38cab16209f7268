"""Cube."""
