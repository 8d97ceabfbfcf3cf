"""Relational and signal operators."""
