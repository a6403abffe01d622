"""End-to-end jobs, queries and their SQL."""
