"""Queries over the driver's tables: each module has QUERIES, by name, and ORACLES, their SQL."""
