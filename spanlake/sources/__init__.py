"""Readers of binary captures and of tables."""
