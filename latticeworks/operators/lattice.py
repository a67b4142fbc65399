"""Square lattices: keys, fishnets, zonal statistics, resampling, slope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeworks.functions import rings
from latticeworks.functions.scalars import round_even
from latticeworks.operators import order
from latticeworks.session import checkpointed

# Columns per row of a packed key; a lattice with more columns states its own stride.
KEY_STRIDE = 2000


def lattice_index(p: Column, origin: float, size: float) -> Column:
    return F.floor((p - F.lit(origin)) / F.lit(size)).cast("long")


def cell_key(
    x: Column, y: Column, x0: float, y0: float, size: float, stride: int = KEY_STRIDE
) -> Column:
    """Packed key row * stride + column of the cell that holds a point.

    A column outside 0 .. stride - 1 would share the key of a cell in another row: the job fails.
    """
    col = lattice_index(x, x0, size)
    key = lattice_index(y, y0, size) * stride + col
    outside = F.raise_error(F.concat(F.lit(f"column outside 0..{stride - 1}: "), col.cast("string"))).cast("long")
    return F.when(col.isNull() | col.between(0, stride - 1), key).otherwise(outside)


def unpack_key(key: Column, stride: int = KEY_STRIDE) -> tuple[Column, Column]:
    """(row, column) of a packed key."""
    return F.floor(key / stride).cast("long"), F.pmod(key, F.lit(stride)).cast("long")


def extent(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Bounds of cell centroids, widened by half a cell."""
    half = size / 2
    return df.agg(
        (F.min(x) - half).alias("x_min"),
        (F.min(y) - half).alias("y_min"),
        (F.max(x) + half).alias("x_max"),
        (F.max(y) + half).alias("y_max"),
    )


def block_key(x: Column, y: Column, size: float) -> Column:
    """Text key of the square block that holds a point."""
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def parent_key(key: Column, stride: int = KEY_STRIDE) -> Column:
    """South-west child key of the twice-as-large parent cell."""
    row, col = unpack_key(key, stride)
    return (row - row % 2) * stride + (col - col % 2)


def inherit_from_parent(
    cells: DataFrame, parents: DataFrame, key: str, parent: str, first_by: str, values: Sequence[str]
) -> DataFrame:
    """Children take the values of their parent cell (first parent per key kept)."""
    from latticeworks.operators.joins import keep_first

    unique = keep_first(parents, [parent], [first_by]).select(
        F.col(parent).alias("_parent"), *values
    )
    keyed = cells.withColumn("_parent", parent_key(F.col(key)))
    return keyed.join(unique, "_parent", "left").drop("_parent")


def cell_square(row: Column, col: Column, x0: float, y0: float, size: float) -> Column:
    side = F.lit(float(size))
    return rings.rectangle(F.lit(x0) + col * size, F.lit(y0) + row * size, side, side)


def fishnet(
    spark: SparkSession, boundary: Sequence[tuple[float, float]], size: float, label: str
) -> DataFrame:
    """Floor-aligned square cells clipped to a boundary ring, with ids.

    The candidate lattice comes from ``spark.range``, so it is generated in
    parallel. Cells no boundary edge touches are wholly inside or outside
    (tested at their centre); only touched cells are clipped.
    """
    xs, ys = [p[0] for p in boundary], [p[1] for p in boundary]
    x0, y0 = (min(xs) // size) * size, (min(ys) // size) * size
    n_cols = int(-(-(max(xs) - x0) // size)) or 1
    n_rows = int(-(-(max(ys) - y0) // size)) or 1
    ring = F.array(*[rings.point(F.lit(float(x)), F.lit(float(y))) for x, y in boundary])
    cells = spark.range(n_cols * n_rows).select(
        F.floor(F.col("id") / n_rows).cast("long").alias("col"),
        (F.col("id") % n_rows).alias("row"),
    )
    left, low = F.lit(x0) + F.col("col") * size, F.lit(y0) + F.col("row") * size
    edges = spark.createDataFrame(
        [(*a, *b) for a, b in zip(boundary, boundary[1:])], "ax double, ay double, bx double, by double"
    )
    touched = segment_cells(edges, x0, y0, size).select("col", "row").distinct()
    marked = cells.join(touched.withColumn("_edge", F.lit(True)), ["col", "row"], "left")
    square = cell_square(F.col("row"), F.col("col"), x0, y0, size)
    centre_in = rings.point_in_ring(left + size / 2, low + size / 2, ring)
    part = F.when(F.col("_edge"), rings.clip_to_box(ring, left, low, left + size, low + size)).when(
        centre_in, square
    )
    # The grid is a durable product and numbering reads it several times, so
    # the clipped cells are written once.
    shaped = checkpointed(marked.select("col", "row", part.alias("ring")).where(F.size("ring") > 3))
    kept = shaped.withColumn("cell_area_m2", rings.ring_area(F.col("ring"))).where("cell_area_m2 > 0")
    cx, cy = rings.ring_centroid(F.col("ring"))
    numbered = order.ordinals(
        kept.withColumn("_key", F.col("col") * n_rows + F.col("row")), "_key", "_ord"
    )
    return numbered.select(
        F.format_string(f"{label}_%08d", F.col("_ord")).alias("grid_id"),
        F.lit(int(size)).alias("grid_size_m"),
        "col", "row",
        cx.alias("centroid_x"), cy.alias("centroid_y"),
        round_even("cell_area_m2", 1).alias("cell_area_m2"),
        "ring",
    )


def segment_cells(df: DataFrame, x0: float, y0: float, size: float, pad: float = 0.0) -> DataFrame:
    """One row per (segment, crossed cell); segments run (ax, ay) - (bx, by).

    With ``pad``, cells that near the segment that much along an axis are listed too.

    The segment is cut by the columns it spans; inside each column strip it
    crosses a run of rows. No cell outside the line is generated.
    """
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))

    def index(v: Column, o: float) -> Column:
        return F.floor((v - F.lit(o)) / F.lit(float(size))).cast("long")

    cols = df.withColumn(
        "col", F.explode(F.sequence(index(F.least(ax, bx) - pad, x0), index(F.greatest(ax, bx) + pad, x0)))
    )
    strip_l, strip_r = F.lit(x0) + F.col("col") * size - pad, F.lit(x0) + (F.col("col") + 1) * size + pad

    def y_at(x: Column) -> Column:
        return F.when(bx != ax, ay + (by - ay) * (x - ax) / (bx - ax)).otherwise(ay)

    enter, leave = F.greatest(F.least(ax, bx), strip_l), F.least(F.greatest(ax, bx), strip_r)
    ya = F.when(bx != ax, y_at(enter)).otherwise(F.least(ay, by))
    yb = F.when(bx != ax, y_at(leave)).otherwise(F.greatest(ay, by))
    rows = F.sequence(index(F.least(ya, yb) - pad, y0), index(F.greatest(ya, yb) + pad, y0))
    return cols.withColumn("row", F.explode(rows))


def clipped_length(size: float, x0: float = 0.0, y0: float = 0.0) -> Column:
    """Length of a segment (ax, ay) - (bx, by) inside its cell (col, row)."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    t_in, t_out = F.lit(0.0), F.lit(1.0)
    for a, b, lo in (
        (ax, bx, F.lit(x0) + F.col("col") * size),
        (ay, by, F.lit(y0) + F.col("row") * size),
    ):
        t0, t1 = (lo - a) / (b - a), (lo + size - a) / (b - a)
        moving = b != a
        t_in = F.greatest(t_in, F.when(moving, F.least(t0, t1)).otherwise(F.lit(0.0)))
        t_out = F.least(t_out, F.when(moving, F.greatest(t0, t1)).otherwise(F.lit(1.0)))
    return F.greatest(t_out - t_in, F.lit(0.0)) * F.hypot(bx - ax, by - ay)


# --- zonal statistics -------------------------------------------------------------


def zonal(pixels: DataFrame, zone: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Aggregate pixels per zone; pixels with a null zone are outside."""
    return (
        pixels.na.drop(subset=list(zone)).groupBy(*zone).agg(*[c.alias(k) for k, c in columns.items()])
    )


def height_zonal(
    grid: DataFrame, pixels: DataFrame, zone: Sequence[str], gross: str, fraction: str
) -> DataFrame:
    """Per-cell mean gross height, mean fraction and implied net height.

    Cells without valid pixels stay null; a zero fraction gives a zero height.
    """
    valid = F.col(gross).isNotNull() & F.col(fraction).isNotNull()
    sums = zonal(pixels, zone, {
        "_src": F.count(F.lit(1)),
        "n_valid_pixels": F.count_if(valid),
        "_g": F.sum(F.when(valid, F.col(gross))),
        "_f": F.sum(F.when(valid, F.col(fraction))),
    })
    n, g, f = F.col("n_valid_pixels"), F.col("_g"), F.col("_f")
    some = n > 0
    joined = grid.join(sums, list(zone), "left").na.fill(0, ["_src", "n_valid_pixels"])
    return joined.select(
        *grid.columns,
        F.col("_src").alias("n_source_pixels"),
        n,
        (F.col("_src") - n).alias("n_nodata_pixels"),
        round_even(F.when(some, g / n), 6).alias("cell_agbh_mean_m"),
        round_even(F.when(some, f / n), 6).alias("cell_built_fraction_mean"),
        round_even(F.when(some & (f > 0), g / f).when(some, 0.0), 6).alias("cell_anbh_derived_m"),
    )


def weighted_product(
    grid: DataFrame, pixels: DataFrame, zone: Sequence[str], height: str, fraction: str
) -> DataFrame:
    """Second height product: fraction-weighted net, gross and mean fraction."""
    sums = zonal(pixels, zone, {
        "_n": F.count(F.lit(1)),
        "_hf": F.coalesce(F.sum(F.col(height) * F.col(fraction)), F.lit(0.0)),
        "_f": F.coalesce(F.sum(fraction), F.lit(0.0)),
    })
    hf, f, n = F.col("_hf"), F.col("_f"), F.col("_n")
    return grid.join(sums, list(zone), "left").select(
        *grid.columns,
        F.when(f > 0, hf / f).alias("net_height_m"),
        F.when(n > 0, hf / n).alias("gross_height_m"),
        F.when(n > 0, f / n).alias("building_fraction"),
    )


def sample_at(
    points: DataFrame, pixels: DataFrame, point_index: Mapping[str, Column], value: str, out: str
) -> DataFrame:
    """Pixel value under each point; pixel keys are (col, row)."""
    keyed = points
    for k, c in point_index.items():
        keyed = keyed.withColumn(f"_{k}", c)
    cells = pixels.select(*[F.col(k).alias(f"_{k}") for k in point_index], F.col(value).alias(out))
    keys = [f"_{k}" for k in point_index]
    return keyed.join(cells, keys, "left").drop(*keys)


def resample_nearest(
    target: DataFrame, source: DataFrame, to_source: Mapping[str, Column], value: str
) -> DataFrame:
    """Each target pixel takes the source pixel that holds its centre."""
    return sample_at(target, source, to_source, value, value)


def resample_average(
    source: DataFrame, value: str, source_size: float, target_size: float,
    shift_x: float = 0.0, shift_y: float = 0.0,
) -> DataFrame:
    """Target pixel = overlap-weighted mean of the source pixels under it.

    Source pixel (col, row) covers [col, col+1) x [row, row+1) times
    ``source_size``; the target lattice starts at (shift_x, shift_y).
    """
    x, y = F.col("col") * source_size - shift_x, F.col("row") * source_size - shift_y

    def covered(lo: Column) -> Column:
        first = F.floor(lo / target_size).cast("long")
        last = (F.ceil((lo + source_size) / target_size) - 1).cast("long")
        return F.explode(F.sequence(first, F.greatest(first, last)))

    spread = source.withColumn("_x", x).withColumn("_y", y)
    spread = spread.withColumn("tcol", covered(F.col("_x"))).withColumn("trow", covered(F.col("_y")))

    def overlap(lo: str, t: str) -> Column:
        start = F.greatest(F.col(lo), F.col(t) * target_size)
        end = F.least(F.col(lo) + source_size, (F.col(t) + 1) * target_size)
        return end - start

    w = F.when(F.col(value).isNotNull(), overlap("_x", "tcol") * overlap("_y", "trow"))
    return spread.groupBy("tcol", "trow").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def slope_degrees(pixels: DataFrame, value: str, dx: float, dy: float) -> DataFrame:
    """Slope from central differences, one-sided at the lattice edges.

    Each pixel sends its value to its four neighbours, so one shuffle on the
    pixel key replaces four self-joins. Nodata counts as zero.
    """
    filled = F.coalesce(F.col(value), F.lit(0.0))
    sides = {"c": (0, 0), "e": (-1, 0), "w": (1, 0), "n": (0, -1), "s": (0, 1)}
    sent = pixels.select(F.explode(F.array(*[
        F.struct(
            (F.col("col") + i).alias("col"), (F.col("row") + j).alias("row"),
            F.lit(k).alias("side"), filled.alias("v"),
        )
        for k, (i, j) in sides.items()
    ])).alias("m")).select("m.*")
    got = sent.groupBy("col", "row").agg(*[
        F.max(F.when(F.col("side") == k, F.col("v"))).alias(k) for k in sides
    ]).where(F.col("c").isNotNull())

    def slope(lo: str, hi: str, step: float) -> Column:
        a, b, c = F.col(lo), F.col(hi), F.col("c")
        return (
            F.when(a.isNotNull() & b.isNotNull(), (b - a) / (2 * step))
            .when(b.isNotNull(), (b - c) / step)
            .when(a.isNotNull(), (c - a) / step)
            .otherwise(0.0)
        )

    gx, gy = slope("w", "e", dx), slope("s", "n", dy)
    return got.select("col", "row", F.degrees(F.atan(F.hypot(gx, gy))).alias("slope_deg"))


def region_fishnets(boxes: DataFrame, key: str, size: float) -> DataFrame:
    """Aligned cells for every region box (x0, y0, x1, y1), cut at the box.

    Columns are exploded and spread before rows are, so that a large region
    is not generated by one task.
    """

    def run(lo: str, hi: str):
        first = F.floor(F.col(lo) / size).cast("long")
        return F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(hi) / size).cast("long") - 1)))

    columns = boxes.select("*", run("x0", "x1").alias("col")).repartition(key, "col")
    cells = columns.select("*", run("y0", "y1").alias("row"))
    width = F.least((F.col("col") + 1) * size, F.col("x1")) - F.greatest(F.col("col") * size, F.col("x0"))
    height = F.least((F.col("row") + 1) * size, F.col("y1")) - F.greatest(F.col("row") * size, F.col("y0"))
    return cells.select(key, "col", "row", (width * height).alias("cell_area_m2")).where("cell_area_m2 > 0")
