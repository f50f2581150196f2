"""The pixel-block pyramid against all pixels one by one, and its plan."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.operators import raster as RA
from fieldspark.operators import zones as Z


@pytest.fixture(scope="module")
def pixels(spark):
    rng = random.Random(2)
    rows = [(c + 0.5 - 40, r + 0.5, None if rng.random() < 0.1 else rng.uniform(-1.5, 1.5)) for r in range(90) for c in range(110)]
    rows += [(3.5, 4.5, 0.25), (3.5, 4.5, -0.5)]  # one pixel several times
    return spark.createDataFrame(rows, "x double, y double, ndvi double").cache()


@pytest.fixture(scope="module")
def zones(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        cx, cy, reach = rng.uniform(-40, 70), rng.uniform(0, 90), rng.choice([0.2, 3, 20, 60])
        n = rng.randrange(3, 8)
        points = [(cx + reach * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), cy + reach * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        rows.append((k, [{"x": x, "y": y} for x, y in points]))
    rows += [(100, [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (32, 0), (32, 64), (0, 64))]), (101, [{"x": float(x), "y": float(y)} for x, y in ((500, 500), (501, 500), (501, 501))])]
    return R.with_bounds(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>")).cache()


def numbers(df, columns):
    return {r["id"]: [r["n"], *[r[c] for c in columns]] for r in df.collect()}


@pytest.mark.parametrize("sides", [(64, 32, 8), (16, 4), (8,)])
def test_pyramid_counts_every_pixel(pixels, zones, sides):
    totals = Z.zone_totals(Z.pixel_pyramid(pixels, 1.0, sides=sides), zones, "id").cache()
    want = numbers(RA.zonal_stats(pixels, zones, "id", 8.0), ["mean", "min", "max", "std"])
    got = numbers(Z.centre_stats(totals, "id"), ["mean", "min", "max", "std"])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    touched = numbers(RA.zonal_all_touched(pixels, zones, "id", 1.0), ["mean", "min", "max"])
    got = numbers(Z.touch_stats(totals, "id"), ["mean", "min", "max"])
    assert set(got) == set(touched) and all(got[k] == pytest.approx(touched[k], abs=1e-9) for k in touched)
    fallback = {r["id"]: (r["ndvi"], r["outcome"]) for r in Z.mean_or_touched(totals, zones, "id").collect()}
    old = {r["id"]: (r["ndvi"], r["outcome"]) for r in RA.zonal_mean_fallback(pixels, zones, "id", 1.0, 8.0).collect()}
    assert {k: v[1] for k, v in fallback.items()} == {k: v[1] for k, v in old.items()}
    assert all(fallback[k][0] == pytest.approx(v[0]) for k, v in old.items() if v[0] is not None)


def test_zones_take_whole_blocks(pixels, zones):
    """Few pixels of a large zone are tested, and the ring does not travel with them."""
    pyramid = Z.pixel_pyramid(pixels, 1.0)
    big = zones.where("id = 100")
    big = R.with_bounds(big.select("id", F.transform("ring", lambda p: R.point(p["x"] * 2 - 30.1, p["y"] + 0.1)).alias("ring")))
    totals = Z.zone_totals(pyramid, big, "id", touch=False)
    text = totals._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "Python" not in text and "BroadcastNestedLoop" not in text
    assert totals.first()["n"] == RA.zonal_stats(pixels, big, "id", 8.0).first()["n"]


def test_zones_meet_their_blocks_once(spark, pixels, zones):
    """One join of zones and blocks whatever the levels, and zones without pixels are gone before any test of squares."""
    far = zones.withColumns({"id": F.col("id") + 1000, "ring": F.transform("ring", lambda p: R.point(p["x"] + 5000, p["y"]))})
    many = zones.union(R.with_bounds(far.select("id", "ring")))
    totals = Z.zone_totals(Z.pixel_pyramid(pixels, 1.0), many, "id")
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and plan.count("Join LeftSemi") == 1
    want = numbers(RA.zonal_all_touched(pixels, zones, "id", 1.0), ["mean", "min", "max"])
    got = numbers(Z.touch_stats(totals, "id"), ["mean", "min", "max"])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
