"""Spatial joins through grid cells: equi-joins on a derived cell key, then an exact test.

Polygons sit on the finest grid level where their box covers few cells, so large polygons do not explode; points carry
one key per level that occurs in the polygon side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import ring as R

#: Points and polygons of a grid cell that meet at once, and edges that are looked at together.
POINTS, POLYGONS, EDGES = 1024, 256, 1 << 20
SPAN = 4  # widest box side, in cells, before a polygon moves to the next level


def _level(minx: Column, miny: Column, maxx: Column, maxy: Column, cell: float) -> Column:
    side = F.greatest(maxx - minx, maxy - miny)
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(1e-9)) / F.lit(cell * SPAN)))).cast("int")


def _axis(v: Column, cell: float, level: Column) -> Column:
    return F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), level))).cast("long")


def _by_cell(df: DataFrame, *cell: str) -> DataFrame:
    """Rows dealt out by grid cell to all tasks. The size of a table says little about its pairs: a table of one small file would leave them
    to one task, and a broadcast of rows that were copied to their cells fills the driver."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)


def explode_cells(df: DataFrame, cell: float, prefix: str = "_") -> DataFrame:
    """One row per covered cell of the box columns ``minx..maxy``; adds level and cell keys."""
    df = df.withColumn(f"{prefix}lv", _level(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cell))
    lv = F.col(f"{prefix}lv")
    df = df.withColumn(
        f"{prefix}cx", F.explode(F.sequence(_axis(F.col("minx"), cell, lv), _axis(F.col("maxx"), cell, lv)))
    )
    return df.withColumn(
        f"{prefix}cy", F.explode(F.sequence(_axis(F.col("miny"), cell, lv), _axis(F.col("maxy"), cell, lv)))
    )


def levels_in_use(polygons: DataFrame, cell: float) -> Column:
    """Scalar subquery: the distinct grid levels of a polygon side (at most one per power of two)."""
    used = polygons.select(_level(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), cell).alias("lv"))
    return used.agg(F.collect_set("lv").alias("lv")).scalar()


def join_points_polygons(
    points: DataFrame,
    polygons: DataFrame,
    cell: float,
    x: str = "x",
    y: str = "y",
    ring: str = "ring",
    boundary: str = "include",
    keep: list[str] | None = None,
) -> DataFrame:
    """Pairs (point row, polygon row) where the polygon holds the point. ``polygons`` needs box columns, and ``parts`` or the ring.

    Polygons of ``parts`` meet the points of a cell in blocks, edge by edge in numpy. ``keep``: the columns that are wanted.
    """
    keyed = points.withColumn("_lv", F.explode(levels_in_use(polygons, cell)))
    keyed = keyed.withColumns(
        {"_cx": _axis(F.col(x), cell, F.col("_lv")), "_cy": _axis(F.col(y), cell, F.col("_lv"))}
    )
    keyed = _by_cell(keyed, "_lv", "_cx", "_cy")
    wanted = [*points.columns, *polygons.columns] if keep is None else keep
    if "parts" in polygons.columns:
        edged = polygons.withColumn("_es", R.parts_edges(F.col("parts"))).where(F.col("_es").isNotNull())
        cells = _by_cell(explode_cells(edged, cell), "_lv", "_cx", "_cy")
        own = [c for c in wanted if c in points.columns]
        near = keyed.select("_lv", "_cx", "_cy", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), *own)
        return _held_points(near, cells, own, [c for c in wanted if c not in own], boundary).select(*wanted)
    cells = _by_cell(explode_cells(polygons, cell), "_lv", "_cx", "_cy")
    px, py = keyed[x], keyed[y]
    near = (
        (keyed["_lv"] == cells["_lv"])
        & (keyed["_cx"] == cells["_cx"])
        & (keyed["_cy"] == cells["_cy"])
        & (px >= cells["minx"])
        & (px <= cells["maxx"])
        & (py >= cells["miny"])
        & (py <= cells["maxy"])
    )
    pairs = keyed.join(cells.hint("shuffle_merge"), near).drop("_lv", "_cx", "_cy")
    held = pairs.filter(R.contains_point(F.col(ring), F.col(x), F.col(y), boundary))
    return held if keep is None else held.select(*keep)


def _blocks(df: DataFrame, columns: list[str], name: str, size: int) -> DataFrame:
    """Rows of a grid cell in arrays of at most ``size``."""
    cell = ["_lv", "_cx", "_cy"]
    nth = F.floor((F.row_number().over(Window.partitionBy(*cell).orderBy(F.lit(0))) - 1) / size)
    return df.withColumn("_nth", nth).groupBy(*cell, "_nth").agg(F.collect_list(F.struct(*columns)).alias(name)).drop("_nth")


def _held_points(points: DataFrame, polygons: DataFrame, own: list[str], other: list[str], boundary: str) -> DataFrame:
    """Columns ``own`` of points and ``other`` of polygons for the pairs of a cell where the edges ``_es`` hold the point: ``ring.edges_hold`` on arrays."""
    box = ["minx", "miny", "maxx", "maxy"]
    near = _blocks(points, ["_x", "_y", *own], "_p", POINTS)
    shapes = polygons.withColumns({f"_{c}": F.col(c).cast("double") for c in box})
    blocks = near.join(_blocks(shapes, [f"_{c}" for c in box] + ["_es", *other], "_q", POLYGONS).hint("shuffle_merge"), ["_lv", "_cx", "_cy"]).select("_p", "_q")

    def numbers(column: pa.Array) -> np.ndarray:
        return column.to_numpy(zero_copy_only=False).astype(np.float64)

    def held(x, y, ends, start, count, at, who) -> np.ndarray:
        """For each pair (point ``at``, polygon ``who``) whether its edges hold it."""
        n = count[who]
        pair = np.repeat(np.arange(len(who)), n)
        e = np.arange(len(pair)) + np.repeat(start[who] - np.cumsum(n) + n, n)
        py = y[at][pair]
        cut = np.flatnonzero((ends["ay"][e] > py) != (ends["by"][e] > py))
        ax, ay, bx, by = (ends[c][e[cut]] for c in ("ax", "ay", "bx", "by"))
        crosses = x[at][pair[cut]] < (bx - ax) * (py[cut] - ay) / (by - ay) + ax
        inside = np.bincount(pair[cut[crosses]], minlength=len(who)) % 2 == 1
        if boundary == "half_open":
            return inside
        px = x[at][pair]
        ax, ay, bx, by = (ends[c][e] for c in ("ax", "ay", "bx", "by"))
        within = (px >= np.minimum(ax, bx)) & (px <= np.maximum(ax, bx)) & (py >= np.minimum(ay, by)) & (py <= np.maximum(ay, by))
        on = np.zeros(len(who), bool)
        on[pair[within & ((bx - ax) * (py - ay) == (by - ay) * (px - ax))]] = True
        return inside & ~on if boundary == "exclude" else inside | on

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p, q = (batch.column(c).slice(i, 1).flatten() for c in ("_p", "_q"))
                x, y = numbers(p.field("_x")), numbers(p.field("_y"))
                x0, y0, x1, y1 = (numbers(q.field(f"_{c}"))[:, None] for c in box)
                who, at = np.nonzero((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1))
                lists = q.field("_es")
                flat = lists.flatten()
                ends = {v + c: numbers(flat.field(v).field(c)) for v in "ab" for c in "xy"}
                count = np.diff(np.asarray(lists.offsets)).astype(np.int64)
                start = np.cumsum(count) - count
                upto = np.cumsum(count[who])
                begin = 0
                while begin < len(who):
                    end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + EDGES, "right")))
                    good = held(x, y, ends, start, count, at[begin:end], who[begin:end])
                    points_in, polygons_in = pa.array(at[begin:end][good]), pa.array(who[begin:end][good])
                    begin = end
                    if len(points_in):
                        columns = [p.field(c).take(points_in) for c in own] + [q.field(c).take(polygons_in) for c in other]
                        yield pa.RecordBatch.from_arrays(columns, [*own, *other])

    fields = [*points.select(*own).schema.fields, *polygons.select(*other).schema.fields]
    return blocks.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def join_polygons(
    left: DataFrame, right: DataFrame, cell: float, touching: bool = True
) -> DataFrame:
    """Pairs of rows whose polygons intersect. Columns of ``right`` must not clash apart from ``ring`` and the box,
    which come back as ``ring_r``, ``minx_r`` …

    A pair meets in several cells; only the cell that holds the lower corner of the common box keeps it, so no
    ``distinct`` is needed. Both sides share one level: the coarser of the two.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    other = right.withColumnsRenamed({c: f"{c}_r" for c in ["ring", *box]})
    levels_l, levels_r = levels_in_use(left, cell), levels_in_use(right, cell)
    l = left.withColumn("_own", _level(*[F.col(c) for c in box], cell))
    r = other.withColumn("_own_r", _level(*[F.col(f"{c}_r") for c in box], cell))
    # a row appears on its own level and on every coarser level used by the other side
    l = l.withColumn("_lv", F.explode(F.array_union(F.array("_own"), levels_r))).filter("_lv >= _own")
    r = r.withColumn("_lv_r", F.explode(F.array_union(F.array("_own_r"), levels_l))).filter("_lv_r >= _own_r")
    for lo, hi, name in (("minx", "maxx", "_cx"), ("miny", "maxy", "_cy")):
        l = l.withColumn(
            name, F.explode(F.sequence(_axis(F.col(lo), cell, F.col("_lv")), _axis(F.col(hi), cell, F.col("_lv"))))
        )
        r = r.withColumn(
            f"{name}_r",
            F.explode(
                F.sequence(_axis(F.col(f"{lo}_r"), cell, F.col("_lv_r")), _axis(F.col(f"{hi}_r"), cell, F.col("_lv_r")))
            ),
        )
    near = (
        (F.col("_lv") == F.col("_lv_r"))
        & (F.col("_cx") == F.col("_cx_r"))
        & (F.col("_cy") == F.col("_cy_r"))
        & (F.greatest("_own", "_own_r") == F.col("_lv"))
        & (F.col("minx") <= F.col("maxx_r"))
        & (F.col("maxx") >= F.col("minx_r"))
        & (F.col("miny") <= F.col("maxy_r"))
        & (F.col("maxy") >= F.col("miny_r"))
        & (_axis(F.greatest("minx", "minx_r"), cell, F.col("_lv")) == F.col("_cx"))
        & (_axis(F.greatest("miny", "miny_r"), cell, F.col("_lv")) == F.col("_cy"))
    )
    l, r = _by_cell(l, "_lv", "_cx", "_cy"), _by_cell(r, "_lv_r", "_cx_r", "_cy_r")
    pairs = l.join(r.hint("shuffle_merge"), near).drop("_own", "_own_r", "_lv", "_lv_r", "_cx", "_cx_r", "_cy", "_cy_r")
    # of upright rectangles the boxes have said all; the test of edges would keep the whole join from being compiled
    if not touching or all(df.where(~R.is_own_box(F.col("ring"), *[F.col(c) for c in box])).isEmpty() for df in (left, right)):
        return pairs
    return pairs.filter(R.polygons_intersect(F.col("ring"), F.col("ring_r")))


def first_match(pairs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order`` (which must break ties)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def point_in_polygon_first(
    points: DataFrame, polygons: DataFrame, cell: float, point_key: str, polygon_key: str, boundary: str = "exclude"
) -> DataFrame:
    """Every point once, with the lowest-keyed polygon that holds it (null when none). Distinct positions meet distinct shapes with their first key."""
    shape = [c for c in ("ring", "parts", "minx", "miny", "maxx", "maxy") if c in polygons.columns]
    firsts = polygons.groupBy(*shape).agg(F.min(polygon_key).alias(polygon_key))
    held = join_points_polygons(points.select("x", "y").distinct(), firsts, cell, boundary=boundary, keep=["x", "y", polygon_key]).groupBy("x", "y").agg(F.min(polygon_key).alias(polygon_key))
    hits = points.select(point_key, "x", "y").join(held, ["x", "y"]).groupBy(point_key).agg(F.min(polygon_key).alias(polygon_key))
    return points.join(hits, point_key, "left")


def smallest_containing(
    points: DataFrame, polygons: DataFrame, cell: float, point_key: str, polygon_key: str
) -> DataFrame:
    """Per point the smallest polygon that holds it; ties by key."""
    pairs = join_points_polygons(points.select(point_key, "x", "y"), polygons, cell)
    ranked = F.struct(R.area(F.col("ring")).alias("area"), F.col(polygon_key).alias(polygon_key))
    return (
        pairs.groupBy(point_key)
        .agg(F.min(ranked).alias("_best"))
        .select(point_key, F.col(f"_best.{polygon_key}").alias(polygon_key), F.col("_best.area").alias("area"))
    )


def pick_best_feature(features: DataFrame, query_key: str, near: float = 0.00005) -> DataFrame:
    """Per query point the first feature that holds or nearly touches it, else the nearest, else the first.

    ``features`` has ``x, y`` of the query, ``pos`` of the feature and its ``ring`` (null when it has none).
    """
    distance = R.distance_to_polygon(F.col("ring"), F.col("x"), F.col("y"))
    scored = features.withColumn("_d", F.when(F.col("ring").isNotNull(), distance))
    hit = F.coalesce(F.col("_d") <= F.lit(near), F.lit(False))
    order = F.struct(
        (~hit).alias("a"),
        F.when(hit, F.lit(0.0)).otherwise(F.coalesce(F.col("_d"), F.lit(float("inf")))).alias("b"),
        F.col("pos").alias("c"),
    )
    return scored.groupBy(query_key).agg(
        F.min_by("pos", order).alias("pos"), F.min_by(F.coalesce(F.col("_d"), F.lit(-1.0)), order).alias("distance")
    )
