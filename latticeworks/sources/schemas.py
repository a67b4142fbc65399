"""Explicit schemas of the stage inputs."""

from __future__ import annotations

# Column names and types of the footprint tiles.
FOOTPRINT_TILE = (
    "latitude double, longitude double, area_in_meters double, confidence double, geometry string"
)
CANONICAL = {"area_in_meters": "source_area_m2", "latitude": "lat", "longitude": "lon"}
PIXEL = "row long, col long, band string, epoch int, value float"
REGION = "id string, name string, ring array<struct<x:double,y:double>>"
OPTIONAL_FOOTPRINT = {"height": "double", "num_floors": "double", "class": "string"}
