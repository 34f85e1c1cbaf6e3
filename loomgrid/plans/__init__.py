"""Fixtures, the query catalogue, stages and the command line."""
