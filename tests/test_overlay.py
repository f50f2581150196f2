"""Noding, unions, repair and closing against pixel counts, even-odd sampling and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.operators import overlay as O

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def proper(r: np.ndarray) -> bool:
    """Edges of a ring share nothing but the ends of neighbours."""
    e = O.ring_edges(r - r.min(0))
    i, j = O._meeting_boxes(e)
    near = (np.abs(i - j) == 1) | (np.abs(i - j) == len(e) - 1)
    touch = sum(O._on(e[a], e[b][:, s]).astype(int) for a, b in ((i, j), (j, i)) for s in (slice(0, 2), slice(2, 4)))
    a, b = e[i], e[j]
    cross = (np.sign(O._side(a, b[:, :2])) * np.sign(O._side(a, b[:, 2:])) < 0) & (np.sign(O._side(b, a[:, :2])) * np.sign(O._side(b, a[:, 2:])) < 0)
    return not cross.any() and not touch[~near].any() and len({tuple(p) for p in r.tolist()}) == len(r)


def even_odd(points, n=400):
    """Area by sampling."""
    p = np.array(points, float)
    lo, hi = p.min(0), p.max(0)
    x, y = [lo[k] + (np.arange(n) + 0.5) / n * (hi[k] - lo[k]) for k in (0, 1)]
    inside = np.zeros((n, n), bool)
    for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0)):
        spans = (ay > y) != (by > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = ax + (y - ay) * (bx - ax) / (by - ay)
        inside ^= spans[:, None] & (x[None, :] < at[:, None])
    return inside.mean() * np.prod(hi - lo)


@pytest.mark.parametrize("seed", range(25))
def test_repair_is_even_odd(seed):
    rng = random.Random(seed)
    points = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.randrange(3, 22))]
    parts = O.overlay([([O.snapped(ring(*points))], 0)], O.odd)
    assert abs(O.parts_area(parts) - even_odd(points)) < 0.6
    assert all(proper(r) for part in parts for r in part)
    assert all(O.ring_area(part[0]) > 0 and all(O.ring_area(h) < 0 for h in part[1:]) for part in parts)


def test_repair_of_broken_rings(spark):
    bow = ring((0, 0), (2, 2), (2, 0), (0, 2))
    spike = ring((0, 0), (2, 0), (5, 0), (2, 0), (2, 2), (0, 2))
    eight = ring((0, 0), (3, 0), (3, 3), (0, 3), (0, 0), (1, 1), (2, 1), (2, 2), (1, 2), (1, 1))
    twice = box(0, 0, 1, 1) + box(0, 0, 1, 1)
    pinched = ring((0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2))
    far = ring((4e5, 4.6e6), (4e5 + 9e3, 4.6e6), (4e5, 4.6e6 + 9e3), (4e5 + 9e3, 4.6e6 + 9e3))
    rows = [(1, bow), (2, spike), (3, eight), (4, twice), (5, None), (6, ring((0, 0), (1, 1))), (7, ring((0, 0), (1, 1), (2, 2))), (8, pinched), (9, far), (10, ring(*[(1, 1)] * 4))]
    df = spark.createDataFrame([(i, r, "p") for i, r in rows], "id int, ring array<struct<x:double,y:double>>, area string")
    got = {r["id"]: (round(r["area"], 6), r["n_parts"], [len(p) for p in r["parts"]]) for r in O.repair(df).collect()}
    assert got == {1: (2, 2, [1, 1]), 2: (4, 1, [1]), 3: (8, 1, [2]), 4: (0, 0, []), 5: (0, 0, []), 6: (0, 0, []), 7: (0, 0, []), 8: (2, 2, [1, 1]), 9: (40500000, 2, [1, 1]), 10: (0, 0, [])}
    rings = O.repair(df).select(F.explode("parts").alias("p")).select(F.explode("p").alias("r"))
    assert rings.where(~R.is_simple(F.col("r"))).count() == 0


def unit_cells(boxes):
    return {(x + i, y + j) for x, y, w, h in boxes for i in range(w) for j in range(h)}


@pytest.mark.parametrize("cell", [1.7, 4.0, 100.0])
def test_union_of_boxes_is_a_pixel_count(spark, cell):
    rng = random.Random(7)
    boxes = {k: [(rng.randrange(25), rng.randrange(25), rng.randrange(1, 7), rng.randrange(1, 7)) for _ in range(40)] for k in range(4)}
    boxes[1] += boxes[1] * 20  # a hot group of copies
    rows = [(k, [box(*b)]) for k, bs in boxes.items() for b in bs] + [(9, None), (8, [[]]), (7, [ring((0, 0), (1, 1), (2, 2))])]
    got = {r["k"]: r for r in O.dissolve(spark.createDataFrame(rows, f"k int, rings {RINGS}").repartition(5), ["k"], cell).collect()}
    assert set(got) == set(boxes) | ({7} & set(got))
    for k, bs in boxes.items():
        pixels = unit_cells(bs)
        sides = sum((x + dx, y + dy) not in pixels for x, y in pixels for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        length = sum(math.dist((a["x"], a["y"]), (b["x"], b["y"])) for p in got[k]["parts"] for r in p for a, b in zip(r, r[1:] + r[:1]))
        assert (got[k]["area"], length, got[k]["n_open"]) == (len(pixels), sides, 0)


@pytest.mark.parametrize("cell", [0.9, 3.0])
def test_union_of_any_polygons(spark, cell):
    """Turned and non-convex pieces: the table's union agrees with the one of a single arrangement and with sampling."""
    rng = random.Random(11)
    pieces = []
    for _ in range(25):
        cx, cy, turn = rng.uniform(0, 8), rng.uniform(0, 8), rng.uniform(0, 6)
        radii = [rng.uniform(0.3, 2.5) for _ in range(rng.randrange(3, 9))]
        pieces.append([(cx + r * math.cos(turn + 2 * math.pi * i / len(radii)), cy + r * math.sin(turn + 2 * math.pi * i / len(radii))) for i, r in enumerate(radii)])
    hole = [[(20, 20), (26, 20), (26, 26), (20, 26)], [(21, 21), (25, 21), (25, 25), (21, 25)]]
    rows = [("a", [ring(*p)]) for p in pieces] + [("a", [ring(*r) for r in hole]), ("a", [box(22, 22, 1, 1)])]
    got = O.dissolve(spark.createDataFrame(rows, f"k string, rings {RINGS}"), ["k"], cell).first()
    alone = O.overlay([(O.turned([O.snapped(ring(*p))]), 0) for p in pieces])
    assert got["n_open"] == 0
    assert got["area"] == pytest.approx(O.parts_area(alone) + 36 - 16 + 1, abs=1e-4)
    lo, hi, n = -3.0, 11.0, 500
    axis = lo + (np.arange(n) + 0.5) * (hi - lo) / n
    inside = np.zeros((n, n), bool)
    for p in pieces:
        one = np.zeros((n, n), bool)
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
            spans = (ay > axis) != (by > axis)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = ax + (axis - ay) * (bx - ax) / (by - ay)
            one ^= spans[:, None] & (axis[None, :] < at[:, None])
        inside |= one
    assert O.parts_area(alone) == pytest.approx(inside.mean() * (hi - lo) ** 2, abs=0.3)
    assert sorted(len(p) for p in got["parts"] if p[0][0]["x"] > 15) == [1, 2]


def segment(radius, chord):
    half = chord / 2
    return radius**2 * math.asin(half / radius) - half * math.sqrt(radius**2 - half**2)


def test_closing_merges_near_pieces_only(spark):
    def pair(gap):
        return [box(0, 0, 20, 30), box(20 + gap, 0, 20, 30)]

    groups = {2: pair(2), 5: pair(5), 7: pair(7), 0: pair(0), 40: [box(0, 0, 20, 30), box(10, 10, 20, 30)]}
    rows = [(k, i, f"P{i}", r) for k, rs in groups.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "k int, pos int, nombre string, ring array<struct<x:double,y:double>>")
    got = {r["k"]: r for r in O.merge_pieces(df, "k", 16.0).collect()}
    assert {k: (r["status"], len(r["parts"]), r["nombre"]) for k, r in got.items()} == {
        2: ("closed", 1, "P0 + P1"), 5: ("closed", 1, "P0 + P1"), 7: ("rejected", 2, "P0 + P1"), 0: ("ok", 1, "P0 + P1"), 40: ("ok", 1, "P0 + P1")
    }
    for gap in (2, 5):
        assert got[gap]["area"] == pytest.approx(1200 + 30 * gap - 2 * segment(3, gap), abs=1.0)
    assert got[7]["area"] == 1200 and got[40]["area"] == 1000


def test_growing_a_box(spark):
    df = spark.createDataFrame([(1, [box(5, 5, 4, 2)])], f"k int, rings {RINGS}")
    area = O.grow(df, ["k"], 1.0, 3.0).first()["area"]
    assert area == pytest.approx(8 + 12 + O.CORNERS / 2 * math.sin(2 * math.pi / O.CORNERS), abs=1e-4)  # round corners are chords
    back = O.close_gaps(df, ["k"], 1.0, 3.0).first()
    assert back["n_parts"] == 1 and back["area"] == pytest.approx(8, abs=0.05)


def test_dissolve_takes_many_keys_per_batch(spark):
    """Keys are dealt out to all tasks and come many at a time, also where a key goes on from batch to batch; a null key is a key."""
    from fieldspark.operators import polygons as G

    box = lambda x, w: [(x, 0.0), (x + w, 0.0), (x + w, 1.0), (x, 1.0)]
    rows = [(k, i, "P", box(float(i), 1.0)) for k in [None, *range(200)] for i in range(1 + (k or 0) % 7)]
    pieces = spark.createDataFrame(rows, "k int, pos int, nombre string, ring array<struct<x:double,y:double>>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        union = O.dissolve(pieces.select("k", F.array("ring").alias("rings")), ["k"], 4.0)
        assert {r["k"]: (r["area"], r["n_parts"]) for r in union.collect()} == {k: (1.0 + (k or 0) % 7, 1) for k in [None, *range(200)]}
        plan = union._jdf.queryExecution().toString()
        adjacent = G.dissolve_adjacent(pieces, "k")
        assert {r["k"]: (r["area"], r["n_rings"], r["status"]) for r in adjacent.collect()} == {k: (1.0 + k % 7, 1, "ok") for k in range(200)}
        assert "FlatMapGroupsInPandas" not in plan + adjacent._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_closing_small_keys_is_closing_in_cells(spark, monkeypatch):
    """A key that is worked on whole in one task comes out as one that is cut into cells, and its zones have few corners."""
    rng = random.Random(11)

    def star(x, y):
        n = rng.randint(3, 9)
        reach = [rng.uniform(3, 9) for _ in range(n)]
        return [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i, r in enumerate(reach)]

    rows = [(k, i, f"P{i}", star(rng.uniform(0, 16 + k), rng.uniform(0, 16))) for k in range(24) for i in range(1 + k % 4)]
    rows += [(50, 0, "flat", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]), (51, 0, "none", None), (52, 0, "a", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (52, 1, "none", None)]
    df = spark.createDataFrame(rows, "k int, pos int, nombre string, ring array<struct<x:double,y:double>>")
    here = {r["k"]: r for r in O.merge_pieces(df, "k", 8.0).collect()}
    monkeypatch.setattr(O, "FEW", 0)
    cells = {r["k"]: r for r in O.merge_pieces(df, "k", 8.0).collect()}
    assert set(here) == set(cells) == {*range(24), 52} and {"ok", "closed"} <= {r["status"] for r in here.values()}
    for k, r in here.items():
        for name in ("status", "nombre", "n_piezas"):
            assert r[name] == cells[k][name], (k, name)
        assert [len(p) for p in r["parts"]] == [len(p) for p in cells[k]["parts"]] and r["area"] == pytest.approx(cells[k]["area"], abs=1e-3)
    round_ring = [(10 * math.cos(math.pi * i / 16), 10 * math.sin(math.pi * i / 16)) for i in range(32)]
    ring = spark.createDataFrame([(1, [round_ring])], f"k int, rings {RINGS}")
    assert O.border_zones(ring, ["k"], 1.0, True).select(F.sum(F.size(F.get("rings", F.lit(0))))).first()[0] == 32 * 6  # 32 * 18 before
    area = O.shrink(ring, ["k"], 1.0, 4.0).first()["area"]
    assert area == pytest.approx(16 * (10 - 1 / math.cos(math.pi / 32)) ** 2 * math.sin(math.pi / 16), abs=1e-3)
