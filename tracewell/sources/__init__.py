"""Readers and writers of captured data."""
