"""Schemas, readers, sinks and fixed lookup layers."""
