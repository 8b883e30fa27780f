"""Fits: what runs where, and in which order."""
