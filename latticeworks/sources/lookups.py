"""Fixed lookup layers: study regions, centres, point-of-interest categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticeworks.functions.projection import utm_point
from latticeworks.functions.scalars import CORRIDORS

# Name -> lon_min, lat_min, lon_max, lat_max (degrees). Boxes
# overlap; the first match in this order wins.
REGION_BOXES = {
    "Accra-Tema": (-0.45, 5.45, 0.10, 5.75),
    "Kumasi": (-1.75, 6.55, -1.45, 6.80),
    "Sekondi-Takoradi": (-1.85, 4.85, -1.55, 5.05),
    "Tamale": (-0.95, 9.30, -0.65, 9.55),
    "Cape Coast": (-1.35, 5.05, -1.10, 5.20),
    "Koforidua": (-0.30, 6.05, 0.00, 6.25),
    "Sunyani": (-2.45, 7.25, -2.25, 7.45),
    "Ho": (0.40, 6.50, 0.65, 6.75),
    "Wa": (-2.60, 10.00, -2.40, 10.15),
    "Bolgatanga": (-0.95, 10.70, -0.70, 10.90),
    "Accra-Kasoa": (-0.45, 5.45, 0.00, 5.75),
    "Accra-Prampram": (-0.30, 5.50, 0.30, 5.75),
    "Accra-Dodowa": (-0.30, 5.60, 0.10, 6.00),
    "Kumasi-Ejisu": (-1.75, 6.55, -1.20, 6.80),
    "Tamale-Savelugu": (-0.95, 9.30, -0.65, 9.85),
}

# Centre name -> lon, lat (degrees).
CENTRES = {
    "Accra": (-0.187, 5.556),
    "Kumasi": (-1.624, 6.688),
    "Tamale": (-0.839, 9.401),
    "Sekondi-Takoradi": (-1.714, 4.934),
    "Cape Coast": (-1.242, 5.105),
    "Koforidua": (-0.261, 6.088),
    "Sunyani": (-2.329, 7.340),
    "Ho": (0.472, 6.601),
    "Wa": (-2.503, 10.060),
    "Bolgatanga": (-0.851, 10.785),
}

# Point-of-interest categories.
POI_CATEGORIES = [
    "school", "hospital", "market", "university", "church", "industrial", "port", "bus_terminal",
]


def boxes() -> list[tuple]:
    return [(name, b[0], b[1], b[2], b[3]) for name, b in REGION_BOXES.items()]


def centres_utm() -> list[tuple]:
    """(column-safe name, easting, northing)."""
    return [
        (name.lower().replace(" ", "_").replace("-", "_"), *utm_point(lon, lat))
        for name, (lon, lat) in CENTRES.items()
    ]


def region_layer(spark: SparkSession) -> DataFrame:
    rows = [
        (i, name, "corridor" if name in CORRIDORS else "urban_region", x0, y0, x1, y1)
        for i, (name, x0, y0, x1, y1) in enumerate(boxes())
    ]
    return spark.createDataFrame(
        rows,
        "ordinal int, name string, type string, lon_min double, lat_min double, "
        "lon_max double, lat_max double",
    )
