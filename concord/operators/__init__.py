"""Operators over blocks and assays."""
