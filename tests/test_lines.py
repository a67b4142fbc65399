"""Polylines by running length against plain geometry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from latticeworks.operators import lines

SCHEMA = "road long, tag string, line array<struct<x:double,y:double>>"


def frame(spark, named):
    return spark.createDataFrame([(k, t, [{"x": x, "y": y} for x, y in v] if v is not None else None) for k, t, v in named], SCHEMA).repartition(3)


def winding(rng, n):
    at = [(rng.uniform(0, 2000), rng.uniform(0, 2000))]
    while len(at) < n:
        at.append((at[-1][0] + rng.uniform(-150, 150), at[-1][1] + rng.uniform(-150, 150)))
    return at


def place(line, m):
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        d = math.dist((ax, ay), (bx, by))
        if m <= d + 1e-9:
            return ax + (bx - ax) * m / d, ay + (by - ay) * m / d
        m -= d
    return line[-1]


def test_places_and_cells(spark):
    rng = random.Random(2)
    roads = [(i, "a" if i % 3 else "b", winding(rng, rng.randrange(2, 40))) for i in range(40)]
    roads += [(90, "a", [(0.0, 0.0), (300.0, 0.0), (300.0, 0.0), (300.0, 100.0)]), (91, "a", [(5.0, 5.0)]), (92, "a", []), (93, "a", None), (94, "a", [(1.0, 1.0), (1.0, 1.0)])]
    segments = lines.measured_segments(frame(spark, roads), "road", columns=["tag"])
    got = {}
    for r in lines.points_along(segments, "road").collect():
        got.setdefault(r.road, []).append((r.at_m, r.x, r.y))
    assert set(got) == {k for k, _, v in roads if k < 91}
    for k, _, line in roads[:41]:
        total = sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))
        n = max(2, int(total / 100))
        found = sorted(got[k])
        assert len(found) == n
        for i, (m, x, y) in enumerate(found):
            assert m == pytest.approx(total * i / (n - 1), abs=1e-6) and (x, y) == pytest.approx(place(line, m), abs=1e-5)
    cells = lines.length_by_cell(segments, "road", 250.0, F.col("tag") == "b").collect()
    every = sum(math.dist(a, b) for k, _, v in roads if v for a, b in zip(v, v[1:], strict=False))
    assert sum(c.inside_m for c in cells) == pytest.approx(every)
    assert all(c.inside_m <= c.total_m + 1e-6 and c.major_m <= c.total_m + 1e-6 for c in cells)
    touched = {}
    for k, _, line in roads[:41]:
        for a, b in zip(line, line[1:], strict=False):
            for i in range(401):
                touched.setdefault((math.floor((a[0] + (b[0] - a[0]) * i / 400) / 250), math.floor((a[1] + (b[1] - a[1]) * i / 400) / 250)), set()).add(k)
    found = {(c.col, c.row): c.n_lines for c in cells}
    assert all(found[c] >= len(k) for c, k in touched.items())
