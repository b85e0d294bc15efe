"""Whole jobs, and the queries the repository registers."""
