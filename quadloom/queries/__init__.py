"""Queries that the driver runs, with their SQL where SQL can say them."""
