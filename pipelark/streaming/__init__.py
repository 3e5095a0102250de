"""Queries over folders that files are still being added to."""
