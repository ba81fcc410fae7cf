"""Queries registered for the side-by-side check, and the SQL they must agree with."""
