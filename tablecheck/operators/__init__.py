"""Distributed passes over a table. Each returns metrics per column, never data rows."""
