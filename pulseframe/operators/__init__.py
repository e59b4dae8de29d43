"""Relational and dataflow operators over event tables, gridded fields and series."""
