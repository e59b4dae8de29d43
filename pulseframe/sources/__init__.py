"""Readers, and the tables that queries start from."""
