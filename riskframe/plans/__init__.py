"""Registered queries with their SQL twins, and the end-to-end jobs."""
