"""The stages of a query as DataFrame operations."""
