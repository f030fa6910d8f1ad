"""Operators over data and schema metadata."""
