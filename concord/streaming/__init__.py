"""Moments that grow with the data."""
