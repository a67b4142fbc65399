"""Registered queries: each entry pairs a Spark query with its SQL check."""
