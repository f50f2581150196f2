"""Shared borders stay shared, and no ring crosses itself or a neighbour; convex clipping as an expression."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.operators import overlay as O
from fieldspark.operators import polygons as G
from fieldspark.operators import simplify as S

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def wavy(rng, a, b, n, amplitude):
    """Points from a up to, not including, b, off the straight line by up to the amplitude."""
    (ax, ay), (bx, by) = a, b
    length = math.dist(a, b)
    out = [a]
    for i in range(1, n):
        off = rng.uniform(-amplitude, amplitude)
        out.append((ax + (bx - ax) * i / n - (by - ay) / length * off, ay + (by - ay) * i / n + (bx - ax) / length * off))
    return out


def subdivision(seed, n=4, amplitude=0.2):
    """n x n pieces with crooked borders, drawn once and walked from both sides."""
    rng = random.Random(seed)
    line = {}

    def border(a, b):
        if (a, b) not in line:
            pts = wavy(rng, a, b, 12, amplitude) + [b]
            line[a, b], line[b, a] = pts, pts[::-1]
        return line[a, b][:-1]

    return {
        (i, j): [p for a, b in zip(c, c[1:] + c[:1]) for p in border(a, b)]
        for i in range(n) for j in range(n)
        for c in [[(3.0 * i, 3.0 * j), (3.0 * i + 3, 3.0 * j), (3.0 * i + 3, 3.0 * j + 3), (3.0 * i, 3.0 * j + 3)]]
    }


@pytest.mark.parametrize("amplitude, tolerance", [(0.2, 0.25), (0.6, 0.7)])
def test_pieces_stay_without_gaps(spark, amplitude, tolerance):
    pieces = subdivision(1, amplitude=amplitude)
    rows = [(k, ring(p if k % 2 else p[::-1]), "n") for k, p in enumerate(pieces.values())] + [(99, None, "n")]
    df = spark.createDataFrame(rows, f"id int, ring {RING}, n_after string").repartition(3)
    out = S.simplify_together(df, tolerance, 2.0).cache()
    got = {r["id"]: r for r in out.collect()}
    assert got[99]["ring"] is None and all(r["n_after"] < r["n_before"] for k, r in got.items() if k != 99)
    whole = out.where("ring is not null")
    assert whole.where(~R.is_simple(F.col("ring"))).count() == 0
    total = whole.agg(F.sum(R.area(F.col("ring")))).first()[0]
    union = O.dissolve(whole.select(F.lit(1).alias("k"), F.array("ring").alias("rings")), ["k"], 4.0).first()
    assert union["n_parts"] == 1 and len(union["parts"][0]) == 1
    assert union["area"] == pytest.approx(total, abs=1e-4)  # neither gaps nor overlaps


def test_corner_on_a_neighbours_side(spark):
    """One long side, two pieces beside it: the border keeps the common corner."""
    rows = [(1, ring([(0, 0), (4, 0), (4, 2), (0, 2)])), (2, ring([(0, 2), (2, 2), (2, 4), (1, 4.01), (0, 4)])), (3, ring([(2, 2), (4, 2), (4, 4), (2, 4)]))]
    out = {r["id"]: {(p["x"], p["y"]) for p in r["ring"]} for r in S.simplify_together(spark.createDataFrame(rows, f"id int, ring {RING}"), 0.1, 1.5).collect()}
    assert (2.0, 2.0) in out[1] and (2.0, 2.0) in out[2] and len(out[2]) == 4 and len(out[3]) == 4


def test_arcs_that_would_cross_stay(spark):
    """A thin tongue of one piece inside a bay of the other: straightening the bay would cut the tongue off."""
    bay = [(0, 0), (10, 0), (10, 5), (6, 5), (5.2, 1), (4.8, 1), (4, 5), (0, 5)]
    tongue = [(4.9, 8), (5.0, 1.5), (5.1, 8)]
    rows = [(1, ring(bay)), (2, ring(tongue))]
    out = S.simplify_together(spark.createDataFrame(rows, f"id int, ring {RING}"), 6.0, 3.0)
    rings = {r["id"]: r["ring"] for r in out.collect()}
    both = out.select(F.lit(1).alias("k"), F.array("ring").alias("rings"))
    total = out.agg(F.sum(R.area(F.col("ring")))).first()[0]
    assert O.dissolve(both, ["k"], 3.0).first()["area"] == pytest.approx(total, abs=1e-6) and len(rings[2]) == 3


def test_convex_clip_is_the_python_clip(spark):
    rng = random.Random(5)

    def star(n, convex):
        cx, cy = rng.uniform(0, 4), rng.uniform(0, 4)
        return [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n) for r in [2.0 if convex else rng.uniform(0.3, 2.5)]]

    rows = []
    for k in range(120):
        a, b = star(rng.randrange(3, 9), k % 3 == 0), star(rng.randrange(3, 9), k % 2 == 0)
        rows.append((k, ring(a if k % 5 else a[::-1]), ring(b if k % 7 else b[::-1] + b[-1:])))
    rows.append((500, ring([(0, 0), (1, 0), (1, 1)]), ring([(9, 9), (10, 9), (10, 10)])))
    df = spark.createDataFrame(rows, f"k int, ring {RING}, ring_r {RING}")
    want = {k: G.intersection_area_of(G._points(a), G._points(b)) for k, a, b in rows}
    got = {r["k"]: r["overlap"] for r in G.intersection_area(df).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    convex = df.where(R.is_convex(R.anticlockwise(F.col("ring_r"))))
    assert 40 < convex.count() < 100
    fast = G.intersection_area(convex, convex=True)
    assert {r["k"]: pytest.approx(r["overlap"], abs=1e-9) for r in fast.collect()} == {k: want[k] for k in [r["k"] for r in convex.collect()]}
    assert "Python" not in fast._jdf.queryExecution().toString() and "InPandas" not in fast._jdf.queryExecution().toString()


def test_simplifying_broadcasts_no_points(spark, tmp_path):
    """A table of few bytes comes to many sides and cells: none of its joins may go through the driver."""
    rows = [(1, ring([(0, 0), (4, 0), (4, 2), (0, 2)])), (2, ring([(0, 2), (4, 2), (4, 4), (0, 4)]))]
    made = spark.createDataFrame(rows, f"id int, ring {RING}").withColumn("rid", F.lit(1).cast("long"))
    made.withColumn("pts", F.expr(f"CAST(concat(ring, slice(ring, 1, 1)) AS {S.POINTS})")).write.parquet(str(tmp_path / "rings"))
    df, points = (spark.read.parquet(str(tmp_path / "rings")).select(*c) for c in (["id", "ring"], ["rid", "pts"]))  # of known, small size
    shapes = points.select(F.lit("a").cast("binary").alias("arc"), F.lit(False).alias("whole"), "pts")
    for out in (S.simplify_together(df, 0.1, 1.5), S._with_touching_points(points, 8), S._clashing(shapes, 8)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
