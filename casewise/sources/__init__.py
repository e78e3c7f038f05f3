"""Readers of evidence files and writers of result tables."""
