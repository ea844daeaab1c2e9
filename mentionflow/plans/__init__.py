"""Whole jobs, and the queries over the driver tables with their SQL twins."""
