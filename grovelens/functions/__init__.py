"""Subpackage of grovelens."""
