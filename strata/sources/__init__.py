"""Readers, writers and report formats."""
