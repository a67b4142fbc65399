"""Imports every catalogue module so that its queries register."""

from latticeworks.catalog import footprints, rasters, geometry, tables, models, inputs, shapes  # noqa: F401
from latticeworks.catalog.registry import ORACLES, QUERIES  # noqa: F401
