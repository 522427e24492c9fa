"""Puts the repository root on the import path."""
