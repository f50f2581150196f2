"""Brute force, properties and reruns on small fixtures."""

import datetime as dt
import math
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.operators import crops as C
from fieldspark.operators import forecasting as FC
from fieldspark.operators import interpolation as I
from fieldspark.operators import merge as M
from fieldspark.operators import polygons as G
from fieldspark.operators import raster as RA
from fieldspark.operators import series as S
from fieldspark.operators import spatial as SP
from fieldspark.operators import surfaces as SF
from fieldspark.operators.quantiles import exact_quantiles
from fieldspark.session import number_rows
from fieldspark.streaming import sensors as SS


def grid_frame(spark, values, name="ndvi"):
    rows = [(0, r, c, None if np.isnan(values[r, c]) else float(values[r, c])) for r in range(values.shape[0]) for c in range(values.shape[1])]
    return spark.createDataFrame(rows, f"tile int, r int, c int, {name} double")


def as_grid(df, shape, name):
    out = np.full(shape, np.nan)
    for x in df.collect():
        if x[name] is not None:
            out[x["r"], x["c"]] = x[name]
    return out


def test_number_rows_is_global_order(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(200)]  # one value holds two thirds of the rows
    df = spark.createDataFrame(rows, "id int, k string").repartition(7)
    got = number_rows(df, [F.col("k").asc(), F.col("id").asc()], "n").orderBy("n").collect()
    assert [x.n for x in got] == list(range(1, 201))
    assert [(x.k, x.id) for x in got] == sorted((k, i) for i, k in rows)


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=300).round(2), np.zeros(200)])
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "g int, v double")
    got = {x.g: x for x in exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.98}).collect()}
    for g in (0, 1):
        want = np.quantile(v[g::2], [0.01, 0.5, 0.98])
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(list(want))


def test_quantiles_of_a_column_by_histograms(spark, monkeypatch):
    rng = np.random.default_rng(4)
    probs = {"a": 0.0, "b": 0.01, "c": 0.37, "d": 0.5, "e": 0.999, "f": 1.0}
    for v in (rng.normal(size=3000), np.concatenate([rng.normal(size=500).round(1), np.full(700, 0.25), [1e12, -1e15, 3.0]]), np.full(9, 2.5), np.array([7.0]), np.array([-0.0, 0.0, 5e-324])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(5)
        got = exact_quantiles(df, [], "v", probs).first()
        assert got["n"] == len(v)
        assert [got[k] for k in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df.limit(0), [], "v", probs).collect() == []


@pytest.mark.parametrize("reach", [0, 1, 3])
def test_dilation(spark, reach):
    rng = np.random.default_rng(2)
    bad = rng.random((20, 24)) < 0.05
    want = np.zeros_like(bad)
    for r, c in zip(*np.nonzero(bad)):
        want[max(r - reach, 0) : r + reach + 1, max(c - reach, 0) : c + reach + 1] = True
    df = grid_frame(spark, bad.astype(float), "bad")
    for frame, dense in ((df, True), (df, False), (df.filter("(r * 7 + c * 3) % 5 > 0"), False)):
        got = RA.cloud_buffer(frame, F.col("bad") == 1, reach, ["tile"], dense=dense).collect()
        if frame is df:
            assert all(x.masked == want[x.r, x.c] for x in got)
        else:
            here = {(x.r, x.c) for x in got}
            near = lambda r, c: any(bad[a, b] and (a, b) in here for a in range(max(r - reach, 0), min(r + reach + 1, 20)) for b in range(max(c - reach, 0), min(c + reach + 1, 24)))
            assert all(x.masked == near(x.r, x.c) for x in got)


def test_fill_gaps_reproduces_linear_field(spark):
    r, c = np.mgrid[0:40, 0:40]
    field = 0.01 * r + 0.02 * c
    holes = field.copy()
    holes[5:9, 5:9] = np.nan  # 16 pixels, filled
    holes[15:30, 15:30] = np.nan  # 225 pixels, left
    holes[39, 39] = np.nan  # corner: nearest neighbour
    got = as_grid(RA.fill_gaps(grid_frame(spark, holes), 50, block=16), field.shape, "ndvi")
    assert np.allclose(got[5:9, 5:9], field[5:9, 5:9])
    assert np.isnan(got[15:30, 15:30]).all()
    assert abs(got[39, 39] - field[39, 39]) < 0.03
    one_block = as_grid(RA.fill_gaps(grid_frame(spark, holes), 50, block=64), field.shape, "ndvi")
    assert np.array_equal(np.nan_to_num(got, nan=-9), np.nan_to_num(one_block, nan=-9))


@pytest.mark.parametrize("seed", range(12))
def test_gaps_are_four_connected(seed):
    rng = np.random.default_rng(seed)
    empty = rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.choice([0.2, 0.6, 0.9])
    labels = RA.label_gaps(empty)
    assert ((labels > 0) == empty).all()
    seen = {}
    for start in zip(*np.nonzero(empty)):
        if start in seen:
            continue
        seen[start], todo = start, [start]
        while todo:
            i, j = todo.pop()
            for p in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= p[0] < empty.shape[0] and 0 <= p[1] < empty.shape[1] and empty[p] and p not in seen:
                    seen[p] = start
                    todo.append(p)
    pairs = {(labels[p], s) for p, s in seen.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_large_gaps_are_marked(spark):
    field = np.ones((30, 30))
    field[3:5, 3:5] = np.nan
    field[10:20, 10:20] = np.nan
    out = RA.fill_gaps(grid_frame(spark, field), 50, block=8).where("large").select("r", "c").collect()
    assert sorted(map(tuple, out)) == [(r, c) for r in range(10, 20) for c in range(10, 20)]


def test_fill_mean_smooth(spark):
    rng = np.random.default_rng(3)
    v = rng.random((9, 11))
    v[2, 3] = np.nan
    filled = np.where(np.isnan(v), np.nanmean(v), v)
    d = np.arange(-4, 5)
    k = np.exp(-0.5 * d**2)
    k /= k.sum()
    pad = np.pad(filled, 4, mode="symmetric")
    want = np.apply_along_axis(lambda m: np.convolve(m, k, "valid"), 1, pad)
    want = np.apply_along_axis(lambda m: np.convolve(m, k, "valid"), 0, want)
    got = as_grid(RA.fill_mean_smooth(grid_frame(spark, v), ["tile"]), v.shape, "v")
    assert np.allclose(got, want)


def star(rng, n, cx, cy, size):
    # every gap stays below half a turn, so the ring is simple
    angles = (np.arange(n) + 0.8 * rng.random(n)) / n * 2 * np.pi
    radii = size * (0.3 + 0.7 * rng.random(n))
    return [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a, r in zip(angles, radii)]


def test_two_clipping_methods_agree():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = star(rng, 7, 0, 0, 3), star(rng, 6, *rng.normal(size=2), 3)
        a, b = (p if G._area(p) > 0 else p[::-1] for p in (a, b))
        area = G.intersection_area_of(a, b)
        parts = G._overlay(np.array(a), np.array(b))
        assert sum(abs(G._area(p)) for p in parts) == pytest.approx(area, abs=1e-6)
        assert area <= min(G._area(a), G._area(b)) + 1e-9


def test_split_keeps_area():
    rng = np.random.default_rng(5)
    for _ in range(40):
        p = star(rng, 8, 0, 0, 2)
        p = p if G._area(p) > 0 else p[::-1]
        line = [tuple(map(float, rng.normal(size=2))), tuple(map(float, rng.normal(size=2)))]
        parts = G._halves(p, line, 0.0)
        assert sum(abs(G._area(q)) for q in parts) == pytest.approx(G._area(p), rel=1e-6)


def rings(spark, polygons, key="id"):
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in polygons], f"{key} int, ring array<struct<x:double,y:double>>")
    return R.with_bounds(df)


def test_dissolve_flags_separate_pieces(spark):
    sq = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    tall = [(1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (1.0, 2.0)]  # its side holds the corners of the first piece
    df = rings(spark, [(1, sq(0.0)), (1, tall), (2, sq(0.0)), (2, sq(5.0))]).withColumns({"pos": F.monotonically_increasing_id(), "nombre": F.lit("p")})
    got = {x.id: x for x in G.dissolve_adjacent(df, "id").collect()}
    assert got[1].status == "ok" and got[1].area == pytest.approx(4.0) and got[1].nombre == "p + p"
    assert got[2].status == "needs_closing"


def test_spatial_joins_match_brute_force(spark):
    rng = np.random.default_rng(6)
    polygons = [(i, star(rng, 6, *(rng.random(2) * 40), 2 if i else 30)) for i in range(40)]  # one polygon covers nearly all
    points = [(i, *map(float, rng.random(2) * 40)) for i in range(150)]
    polys = rings(spark, polygons)
    pts = spark.createDataFrame(points, "pid int, x double, y double")
    got = {(x.pid, x.id) for x in SP.join_points_polygons(pts, polys, 2.0).collect()}
    want = {(p[0], i) for p in points for i, ring in polygons if G._contains(np.array(ring), np.array(p[1:]))}
    assert got == want
    other = polys.withColumnRenamed("id", "oid")
    pairs = [(x.id, x.oid) for x in SP.join_polygons(polys, other, 2.0).select("id", "oid").collect()]
    assert len(pairs) == len(set(pairs))
    orient = lambda p: p if G._area(p) > 0 else p[::-1]
    overlap = {(i, j) for i, a in polygons for j, b in polygons if G.intersection_area_of(orient(a), orient(b)) > 1e-9}
    assert overlap <= set(pairs)


@pytest.mark.parametrize("spread", [1.0, 0.001])
def test_knn_matches_brute_force(spark, spread):
    rng = np.random.default_rng(7)
    # a third of the references share one spot, the rest is spread or very dense
    refs = [(i, 5.0, 5.0) if i % 3 == 0 else (i, *(rng.random(2) * 100 * spread).tolist()) for i in range(90)]
    targets = [(i, *(rng.random(2) * 120 - 10).tolist()) for i in range(60)]
    r = spark.createDataFrame(refs, "rid int, x double, y double")
    t = spark.createDataFrame(targets, "tid int, x double, y double")
    for k in (1, 6, 100):
        got = {}
        for x in I.knn_join(t, r, k, "tid", "rid", cell=3.0, levels=6).collect():
            got.setdefault(x.tid, []).append((x["rank"], x.rid))
        for tid, tx, ty in targets:
            want = [rid for _, rid in sorted(((x - tx) ** 2 + (y - ty) ** 2, rid) for rid, x, y in refs)[:k]]
            assert [rid for _, rid in sorted(got[tid])] == want


def test_idw_properties(spark):
    pts = spark.createDataFrame([(i, float(i * 7 % 50), float(i * 3 % 40)) for i in range(30)], "id int, x double, y double")
    st = [(s, float(s * 11 % 50), float(s * 5 % 40)) for s in range(9)]
    constant = spark.createDataFrame([(s, x, y, 1, 7.5) for s, x, y in st], "e int, x double, y double, g int, valor double")
    out = I.idw_adaptive(pts, constant, "id", "e", ["g"], F.lit(2.0)).collect()
    assert len(out) == 30 and all(x.valor == pytest.approx(7.5) for x in out)
    few = I.idw_adaptive(pts, constant.filter("e < 3"), "id", "e", ["g"], F.lit(2.0)).collect()
    assert all(x.valor is None for x in few)
    vary = constant.withColumn("valor", F.col("e").cast("double"))
    many = I.TARGETS, I.GROUPS, I.ELEMENTS
    try:
        whole = {x.id: x.valor for x in I.idw_adaptive(pts, vary, "id", "e", ["g"], F.lit(2.5)).collect()}
        I.TARGETS, I.GROUPS, I.ELEMENTS = 4, 1, 10  # small blocks give the same answer
        parts = {x.id: x.valor for x in I.idw_adaptive(pts, vary, "id", "e", ["g"], F.lit(2.5)).collect()}
    finally:
        I.TARGETS, I.GROUPS, I.ELEMENTS = many
    assert parts == pytest.approx(whole) and all(0 <= v <= 8 for v in whole.values())
    # a short list of neighbours is widened where stations have no value for a group
    gaps = vary.withColumn("g", F.explode(F.array(F.lit(1), F.lit(2)))).filter("g = 1 OR e % 2 = 0")
    full = {(x.id, x.g): x.valor for x in I.idw_adaptive(pts, gaps, "id", "e", ["g"], F.lit(2.5)).collect()}
    listed = {(x.id, x.g): x.valor for x in I.idw_adaptive(pts, gaps, "id", "e", ["g"], F.lit(2.5), listed=2).collect()}
    assert len(full) == 60 and listed == pytest.approx(full)
    far = pts.withColumn("x", F.col("x") + 10_000)
    assert [x.valor for x in I.idw_adaptive(far, constant, "id", "e", ["g"], F.lit(2.0)).collect()] == [None] * 30


def test_idw_blocks_receive_few_values(spark):
    """Stations lie dense and plots many: what meets a block stays near its neighbours' number, and the values are those of brute force."""
    rng = np.random.default_rng(11)
    st = [(s, *(rng.random(2) * 300).tolist()) for s in range(600)]
    rows = [(s, x, y, g, float(s % 17 + g)) for s, x, y in st for g in range(3) if g < 2 or s % 41 == 0]
    pts = [(i, *(rng.random(2) * 300).tolist()) for i in range(200)] + [(1000 + i, 150.0, 150.0) for i in range(20)] + [(2000, None, 3.0)]
    values = spark.createDataFrame(rows, "e int, x double, y double, g int, valor double")
    plots = spark.createDataFrame(pts, "id int, x double, y double")
    want = {}
    for i, px, py in pts[:-1]:
        for g in range(3):
            near = sorted((math.sqrt((x - px) ** 2 + (y - py) ** 2), e, v) for e, x, y, h, v in rows if h == g)[:6]
            radius = next((r for r in I.RADII_KM if near[3][0] <= r), 0)
            held = [(d**-2.5, v) for d, _, v in near if d <= radius]
            want[i, g] = sum(w * v for w, v in held) / sum(w for w, _ in held) if held else None
    many, cut, kept = I.TARGETS, I.cut_lineage, []
    try:
        I.TARGETS, I.cut_lineage = 16, lambda df: kept.append(cut(df)) or kept[-1]
        got = {(x.id, x.g): x.valor for x in I.idw_adaptive(plots, values, "id", "e", ["g"], F.lit(2.5), listed=8).collect()}
    finally:
        I.TARGETS, I.cut_lineage = many, cut
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    # cells of a sixteenth of the radius and less are enough around most blocks, so they receive few of the 600 stations
    levels = [x._wl for x in kept[-1].collect()]
    assert sum(lv >= 2 for lv in levels) > 0.6 * len(levels)
    wide = I.idw_adaptive(plots, values.withColumn("n", F.concat(F.lit("g"), "g")), "id", "e", ["n"], F.lit(2.5), wide=("n", ["g0", "g2", "none"])).collect()
    assert len(wide) == 220 and {x.none for x in wide} == {None}
    assert {(x.id, g): x[f"g{g}"] for x in wide for g in (0, 2)} == {k: pytest.approx(v) for k, v in want.items() if k[1] != 1}


def test_knn_packs_only_what_is_near(spark):
    """Dense references and many copies at one position: few candidates per target, exact neighbours."""
    rng = np.random.default_rng(5)
    refs = [(i, *(rng.random(2) * 10).tolist()) for i in range(3000)] + [(9000 + i, 5.0, 5.0) for i in range(3000)]
    targets = [(i, *(rng.random(2) * 10).tolist()) for i in range(40)]
    got, kept, cut = {}, [], I.cut_lineage
    try:
        I.cut_lineage = lambda df: kept.append(cut(df)) or kept[-1]
        out = I.knn_join(spark.createDataFrame(targets, "tid int, x double, y double"), spark.createDataFrame(refs, "rid int, x double, y double"), 4, "tid", "rid", cell=10.0)
    finally:
        I.cut_lineage = cut
    assert kept[0].agg(F.sum(F.size("_refs"))).first()[0] < 200 * len(targets)
    for x in out.collect():
        got.setdefault(x.tid, []).append((x["rank"], x.rid))
    for tid, tx, ty in targets:
        want = [rid for _, rid in sorted(((x - tx) ** 2 + (y - ty) ** 2, rid) for rid, x, y in refs)[:4]]
        assert [rid for _, rid in sorted(got[tid])] == want


def test_latest_snapshot_has_all_its_files(spark, tmp_path):
    from fieldspark.sources import files

    spark.range(500).repartition(3).write.parquet(f"{tmp_path}/old")
    time.sleep(1.1)
    spark.range(1000).repartition(8).write.parquet(f"{tmp_path}/new")
    assert files.read_latest_snapshot(spark, f"{tmp_path}/*").count() == 1000


def test_snapshots_in_subfolders_half_written_or_empty(spark, tmp_path):
    from fieldspark.sources import files

    rows = spark.range(1000).withColumn("k", F.col("id") % 4)
    rows.write.partitionBy("k").parquet(f"{tmp_path}/plain")
    latest = lambda: files.read_latest_snapshot(spark, f"{tmp_path}/*")
    assert latest().count() == 1000 and set(latest().columns) == {"id", "k"}
    files.write_snapshot(rows.limit(10), f"{tmp_path}/a", ["k"])
    assert latest().count() == 10
    time.sleep(0.05)
    files.write_snapshot(rows.limit(900), f"{tmp_path}/b")
    files.write_snapshot(rows.limit(800), f"{tmp_path}/c", ["k"])
    assert latest().count() == 800
    assert files.read_manifest(spark, f"{tmp_path}/c")["rows"] == 800
    lost = sorted((tmp_path / "c").rglob("*.parquet"))[0]
    lost.write_bytes(lost.read_bytes()[:-1])  # cut off: the snapshot is not whole
    assert files.read_manifest(spark, f"{tmp_path}/c") is None and latest().count() == 900
    (tmp_path / "b" / files.MANIFEST).write_text("{")
    assert latest().count() == 10
    files.write_snapshot(rows.limit(0), f"{tmp_path}/d")
    assert latest().count() == 0 and latest().columns == ["id", "k"]
    with pytest.raises(FileNotFoundError):
        files.read_latest_snapshot(spark, f"{tmp_path}/none*")


@pytest.mark.parametrize("per_batch", [64, 2])
def test_stream_does_not_depend_on_batches(spark, tmp_path, per_batch):
    rows = spark.range(80).selectExpr(
        "id AS id_medicion", "id % 7 AS id_sensor", "'t' AS id_variable", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast((id * 37) % 80 * 5 AS int)) AS fecha_hora",
        "1.0D AS valor", "'' AS otros_datos",
    )
    for _ in range(2):
        rows.repartition(8).write.mode("append").parquet(f"{tmp_path}/in")
    run = SS.start(SS.readings(spark, f"{tmp_path}/in", files_per_batch=per_batch), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    run.awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert stored.count() == 80 and stored.select("id_sensor", "fecha_hora").distinct().count() == 80
    again = SS.start(SS.readings(spark, f"{tmp_path}/in", files_per_batch=per_batch), f"{tmp_path}/out", f"{tmp_path}/state2", once=True)
    again.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 80


def test_null_keys_are_inserted_once(spark):
    incoming = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    stored = M.insert_if_absent(incoming.limit(0), incoming, ["k"], [F.col("v")])
    assert M.insert_if_absent(stored, incoming, ["k"], [F.col("v")]).count() == 2


def test_surfaces(spark):
    rng = np.random.default_rng(8)
    st = [(i, *(rng.random(2) * 10).tolist()) for i in range(25)]
    df = spark.createDataFrame([(i, x, y, "v", 2 * x - y) for i, x, y in st], "estacion_id int, x double, y double, variable string, valor double")
    nodes = spark.createDataFrame([(i, x, y) for i, x, y in st], "cell long, x double, y double")
    want = {i: 2 * x - y for i, x, y in st}
    rbf = {x.cell: x.valor for x in SF.evaluate(nodes, SF.rbf_fit(df, ["variable"]), ["variable"], "rbf").collect()}
    assert rbf == pytest.approx(want, abs=1e-6)
    cells = spark.createDataFrame([(i, *(rng.random(2) * 4 + 3).tolist()) for i in range(40)], "cell long, x double, y double")
    exact = {x.cell: 2 * x.x - x.y for x in cells.collect()}
    tin = {x.cell: x.valor for x in SF.tin_surface(cells, df, ["variable"], 2.0, extrapolate=True).collect()}
    assert tin == pytest.approx(exact, abs=1e-6)
    gp = SF.evaluate(nodes, SF.kriging_fit(df, ["variable"]), ["variable"], "gp").collect()
    assert np.corrcoef([x.valor for x in gp], [want[x.cell] for x in gp])[0, 1] > 0.95


def test_large_fits_need_no_dense_system(spark):
    """The ways of many nodes give what one dense system gives; thousands of nodes are triangulated at once."""
    rng = np.random.default_rng(4)
    pts, v = rng.random((500, 2)) * (40, 3), rng.normal(size=500) * 5 + 20
    q = pts / np.sqrt(120 / 500)
    basis = lambda at: np.sqrt(((at[:, None] - q[None]) ** 2).sum(axis=2) + 1)
    at = rng.random((200, 2)) * q.max(axis=0)
    assert basis(at) @ SF.multiquadric_weights(q, v) == pytest.approx(basis(at) @ np.linalg.solve(basis(q), v), abs=1e-5)
    smooth = np.sin(pts[:, 0] / 3) * 5 + rng.normal(size=500) * 0.1
    st = [(i, *p, "v", float(z)) for i, (p, z) in enumerate(zip(pts.tolist(), smooth))]
    df = spark.createDataFrame(st, "estacion_id int, x double, y double, variable string, valor double")
    direct = {(r.x, r.y): (r.w, r.scale) for r in SF.kriging_fit(df, ["variable"]).collect()}
    w, length = SF.gaussian_weights(pts, smooth)
    assert all(direct[tuple(p)] == pytest.approx((z, length), rel=1e-5, abs=1e-5) for p, z in zip(pts.tolist(), w))
    assert SF.rbf_fit(df, ["variable"]).rdd.getNumPartitions() >= SF.FIT_TASKS
    many = rng.random((4000, 2))
    found = SF.triangulate(many)
    a, b, c = (many[list(k)] for k in zip(*found))
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).sum() / 2
    assert len(found) == len(set(map(frozenset, found))) and area == pytest.approx(1.0, abs=0.02)


def test_models_recover_linear_rule(spark):
    rng = np.random.default_rng(9)
    names = [n for p in I.LAG_PREFIX.values() for n in I.lag_names(p)]
    data = pd.DataFrame(rng.random((120, len(names))).round(3) * 10, columns=names)
    for k, target in enumerate(FC.TRAIN_TARGETS):
        data[target] = data["Ev_t-4"] + k
    data.insert(0, "Cl", ["A"] * 115 + ["B"] * 5)
    df = spark.createDataFrame(data)
    models = FC.train_per_crop(df)
    assert {x.Cl: x.n for x in models.collect()} == {"A": 115}  # five rows are too few
    out = FC.predict_per_crop(df.withColumn("id", F.monotonically_increasing_id()), models, ["id", "Ev_t"]).collect()
    assert len(out) == 115
    assert all(x[f"ET_{k}"] == pytest.approx(x.Ev_t + k, abs=0.05) for x in out for k in range(4))
    assert {x.resultado: x.cultivos for x in FC.prediction_outcomes(df, models).collect()} == {"ok": 1, "sin_modelo": 1}


def test_merges_are_repeatable(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d")], "k int, v string")
    once = M.insert_if_absent(stored, incoming, ["k"], [F.col("v")])
    twice = M.insert_if_absent(once, incoming, ["k"], [F.col("v")])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    fresh = incoming.filter("v <> 'd'")
    up = M.upsert(stored, fresh, ["k"])
    assert sorted(map(tuple, M.upsert(up, fresh, ["k"]).collect())) == sorted(map(tuple, up.collect())) == [(1, "a"), (2, "B"), (3, "c")]


def test_current_crop_edges(spark):
    d = dt.date
    rows = [
        (1, 10, None, d(2024, 1, 1), "en_curso", 1),
        (2, 10, d(2024, 1, 1), None, None, 2),  # same start, higher id
        (3, 10, d(2025, 1, 1), None, "eliminado", 3),
        (4, 10, d(2025, 1, 1), None, "en_curso", None),  # outside the chain
        (5, 20, None, None, "en_curso", 5),  # undated but alone
    ]
    df = spark.createDataFrame(rows, "id_cultivo int, id_recinto int, fecha_siembra date, fecha_implantacion date, estado string, id_padre int")
    assert {x.id_recinto: x.id_cultivo for x in C.current_crop(df).collect()} == {10: 2, 20: 5}


def test_stream_keeps_first_and_survives_replay(spark, tmp_path):
    ts = lambda m: dt.datetime(2024, 1, 1, 10, m)
    schema = SS.READINGS_SCHEMA
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(1, 1, "t", ts(0), 1.0, None), (2, 1, "t", ts(0), 2.0, None), (3, 1, "t", ts(1), 3.0, None)], schema).coalesce(1).write.parquet(src)
    SS.start(SS.readings(spark, src), out, state, once=True).awaitTermination()
    spark.createDataFrame([(4, 1, "t", ts(0), 9.0, None), (5, 2, "t", ts(0), 5.0, None)], schema).coalesce(1).write.mode("append").parquet(src)
    SS.start(SS.readings(spark, src), out, state, once=True).awaitTermination()
    # a lost checkpoint replays everything; the table stays the same
    SS.start(SS.readings(spark, src), out, str(tmp_path / "state2"), once=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 3 and {(x.id_sensor, x.fecha_hora.minute) for x in rows} == {(1, 0), (1, 1), (2, 0)}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, inputs):
    from fieldspark.plans import catalogue  # noqa: F401
    from fieldspark.plans.registry import QUERIES

    for name in ("spatial_join_point_in_polygon", "polygons_intersect", "zonal_stats", "knn_join", "idw_adaptive", "idw_grid", "join_asof_nearest_date"):
        physical = plan_of(QUERIES[name](inputs)).split("== Physical Plan ==")[1]
        assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical, name
    top = plan_of(QUERIES["current_crop"](inputs))
    assert "WindowGroupLimit" in top  # the top-1 also runs before the shuffle
    pushed = plan_of(QUERIES["owner_check"](inputs))
    read = re.findall(r"ReadSchema: struct<([^>\n]*)", pushed)
    assert read and not any("o_comment" in r or "o_totalprice" in r for r in read)
    assert re.search(r"PushedFilters: \[\S", pushed)
    mosaic = plan_of(QUERIES["quality_weights"](inputs)).split("== Physical Plan ==")[1]
    assert mosaic.count("Exchange hashpartitioning") == 1
    assert "PythonUDF" not in plan_of(QUERIES["irrigation_dose"](inputs))




def test_boxes_agree_with_general_rings(spark):
    """Upright rectangles take the short way; with a vertex more on a side they take the long one, to the same answer."""
    rng = np.random.default_rng(3)
    rows = [(i, *rng.integers(0, 6, 2).tolist(), *rng.integers(1, 4, 2).tolist(), *rng.integers(0, 6, 2).tolist(), *rng.integers(1, 4, 2).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int")
    box = lambda p: R.rectangle(F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{p}x") + F.col(f"{p}w"), F.col(f"{p}y") + F.col(f"{p}h"))
    more = lambda ring: F.concat(ring, F.array(R.point(F.get(ring, F.lit(0))["x"], (F.get(ring, F.lit(0))["y"] + F.get(ring, F.lit(3))["y"]) / 2)))
    df = df.select("i", box("a").alias("a"), box("b").alias("b"), more(box("a")).alias("al"), more(box("b")).alias("bl"), F.col("bx").cast("double").alias("x"), F.col("by").cast("double").alias("y"))
    tests = [lambda a, b: R.polygons_intersect(a, b), lambda a, b: R.covered_by_tolerance(a, b, 1.0001), lambda a, b: R.covered_by_tolerance(F.reverse(a), b, 0.5)]
    tests += [lambda a, b, k=k: R.contains_point(a, F.col("x"), F.col("y"), k) for k in ("include", "exclude", "half_open")]
    assert df.select(F.count_if(R.is_box(F.col("a"))), F.count_if(R.is_box(F.col("al")))).first() == (120, 0)
    got = df.select(*[t(F.col("a"), F.col("b")).alias(f"s{i}") for i, t in enumerate(tests)], *[t(F.col("al"), F.col("bl")).alias(f"l{i}") for i, t in enumerate(tests)]).collect()
    for i in range(len(tests)):
        assert [r[f"s{i}"] for r in got] == [r[f"l{i}"] for r in got], i
        assert len({r[f"s{i}"] for r in got}) == 2
    short = {r.i: r.overlap for r in G.intersection_area(df.select("i", F.col("a").alias("ring"), F.col("b").alias("ring_r")), convex=True).collect()}
    long = {r.i: r.overlap for r in G.intersection_area(df.select("i", F.col("al").alias("ring"), F.col("bl").alias("ring_r")), convex=True).collect()}
    assert short == pytest.approx(long)
    clip = lambda a, b: {r.i: (r.clipped, r.area if r.clipped else None) for r in G.clip_polygons(df.select("i", F.col(a).alias("ring"), F.col(b).alias("ring_r"))).withColumn("area", R.area(F.col("ring"))).collect()}
    assert clip("a", "b") == {k: (c, pytest.approx(v) if c else None) for k, (c, v) in clip("al", "bl").items()}


def test_pairs_of_polygons_use_all_tasks(spark):
    """A table of one file must not leave its pairs to one task, nor send its copied rows to the driver."""
    one = lambda name: R.with_bounds(spark.range(0, 400, 1, 1).select(F.col("id").alias(name), R.rectangle(F.col("id"), F.lit(0), F.col("id") + 3, F.lit(2)).alias("ring")))
    pairs = SP.join_polygons(one("p"), one("q"), 4.0)
    assert pairs.select(F.spark_partition_id().alias("t")).distinct().count() > 4
    assert "BroadcastHashJoin" not in plan_of(pairs)
    assert pairs.count() == 400 + 2 * (399 + 398 + 397)


def test_equal_shapes_share_their_answer(spark):
    """Copies of a shape meet once: kernels run on distinct shapes, and every row gets its answer."""
    box = lambda x, w: R.rectangle(x, F.lit(0), x + w, F.lit(2))
    left = R.with_bounds(spark.range(60).select((F.col("id") + 100).alias("p"), box(F.col("id") % 3 * 5, F.lit(2)).alias("ring")))
    right = R.with_bounds(spark.range(40).select(F.col("id").alias("q"), box(F.col("id") % 4 * 5 + 1, F.lit(4)).alias("ring")))
    seen, joined = [], G.join_polygons
    try:
        G.join_polygons = lambda a, b, *rest, **kw: seen.append((a.count(), b.count())) or joined(a, b, *rest, **kw)
        got = {r.p: (r.q, r.overlap) for r in G.max_overlap(left, right, "p", "q", 4.0, convex=True).collect()}
        assert seen == [(3, 4)]
        lines = spark.range(50).select(F.col("id").alias("line_id"), F.lit(1.0).alias("ax"), F.lit(0.5).alias("ay"), F.lit(1.0).alias("bx"), F.lit(1.5).alias("by"))
        cut = G.split_by_lines(left, lines, "p", 4.0, 0.0001)
        assert seen[1] == (60, 1)
    finally:
        G.join_polygons = joined
    assert got == {100 + i: (i % 3, 2.0) for i in range(60)}
    assert cut.count() == 60 + 20
    points = spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 3 * 5 + 1.0).alias("x"), F.lit(1.0).alias("y"))
    hits, joined = [], SP.join_points_polygons
    try:
        SP.join_points_polygons = lambda a, b, *rest, **kw: hits.append((a.count(), b.count())) or joined(a, b, *rest, **kw)
        first = SP.point_in_polygon_first(points, left, 4.0, "k", "p")
    finally:
        SP.join_points_polygons = joined
    assert hits == [(3, 3)] and {r.k: r.p for r in first.collect()} == {k: 100 + k % 3 for k in range(30)}


def test_costly_rows_are_spread(spark, inputs):
    from fieldspark.plans import q_geometry, q_sources

    for rows in (q_sources.forecast_docs(inputs), q_sources.feature_answers(inputs), q_sources.geometry_texts(inputs), q_geometry.broken_rings(inputs)):
        assert rows.rdd.getNumPartitions() == 8


def _pairs_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_common_area_of_parts_stays_a_row(spark):
    """Pairs of rectangles with holes and several parts are neither taken apart nor shuffled; other rings, keys that come again and null keys are added up."""
    box = lambda x, y, w, h: [(float(x), float(y)), (x + w * 1.0, float(y)), (x + w * 1.0, y + h * 1.0), (float(x), y + h * 1.0)]
    kind = "array<array<array<struct<x:double,y:double>>>>"
    holed, two = [[box(0, 0, 4, 4), box(1, 1, 2, 2)[::-1]]], [[box(0, 0, 2, 2)], [box(3, 0, 2, 2)]]
    many = [[box(3 * i, 0, 1, 1)] for i in range(7)]
    slanted = [[[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]]]
    left = [(1, holed), (2, two), (3, many), (4, slanted), (5, holed), (5, two), (None, two), (None, holed), (6, None)]
    right = [(1, [[box(0, 0, 2, 2)]]), (2, [[box(0, 0, 20, 3)]]), (3, two), (4, [[box(0, 0, 2, 2)]]), (4, [[box(2, 2, 1, 1)]])]
    a = spark.createDataFrame(left, f"izq int, parts {kind}").withColumn("boxes", G.lone_boxes("izq", "parts"))
    b = spark.createDataFrame(right, f"der int, parts_r {kind}").withColumn("boxes_r", G.lone_boxes("der", "parts_r"))
    assert {r["izq"] for r in a.where("boxes is not null").collect()} == {1, 2, 3}
    pairs = a.crossJoin(b)
    area = lambda df: {(r["izq"], r["der"]): round(r["overlap"], 9) for r in df.collect()}
    fast, slow = G.parts_intersection_area(pairs, ["izq", "der"], boxes=("boxes", "boxes_r")), G.parts_intersection_area(pairs, ["izq", "der"])
    assert area(fast) == area(slow) and fast.count() == slow.count() == 6 * 4
    assert area(fast)[1, 1] == 3.0 and area(fast)[3, 2] == 7.0 and area(fast)[5, 4] == 3.0 + 0.0 + 4.0


def test_pairs_of_rectangles_have_no_test_of_edges(spark):
    """Where all rings are rectangles the join of boxes is the whole test, and the other rings of a clip are looked for on each side before the join."""
    box = F.array(R.point(F.col("x"), F.lit(0.0)), R.point(F.col("x") + 2, F.lit(0.0)), R.point(F.col("x") + 2, F.lit(2.0)), R.point(F.col("x"), F.lit(2.0)))
    slanted = F.array(R.point(F.col("x"), F.lit(0.0)), R.point(F.col("x") + 2, F.lit(0.0)), R.point(F.col("x"), F.lit(2.0)))
    rows = spark.range(12).select("id", F.col("id").cast("double").alias("x"))
    table = lambda ring: R.with_bounds(rows.select("id", ring.alias("ring")))
    boxes, mixed = table(box), table(F.when(F.col("id") % 3 == 0, slanted).otherwise(box))
    joined = lambda l, r: SP.join_polygons(l, r.withColumnRenamed("id", "o"), 1.0)
    assert "aggregate(" not in _pairs_plan(joined(boxes, boxes)) and "aggregate(" in _pairs_plan(joined(mixed, boxes))
    assert joined(boxes, boxes).count() == 12 + 2 * (11 + 10)
    want = joined(mixed, mixed).where(R.polygons_intersect(F.col("ring"), F.col("ring_r"))).count()
    assert joined(mixed, mixed).count() == want
    clipped = lambda l, r: {(v["id"], v["o"]): (round(v["area"], 9), v["clipped"]) for v in G.clip_polygons(joined(l, r).select("id", "o", "ring", "ring_r")).select("id", "o", "clipped", R.area(F.col("ring")).alias("area")).collect()}
    got = clipped(mixed, mixed)
    assert len(got) == want and got[1, 2] == (2.0, True) and got[0, 0] == (2.0, True) and got[0, 1] == (0.5, True) and got[1, 0] == (0.5, True) and got[1, 3] == (4.0, False)


def test_area_of_a_rectangle_is_that_of_its_edges(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in range(200):
        x0, y0, x1, y1 = rng.uniform(-1e3, 1e3, 4).tolist()
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        ring = (ring[n % 4 :] + ring[: n % 4])[:: 1 if n % 3 else -1]
        rows.append((ring + ring[: n % 2],))
    out = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>").select(R.is_box(F.col("ring")).alias("b"), R.area(F.col("ring")).alias("a"), F.abs(R.signed_area(F.col("ring"))).alias("s"))
    assert all(r["b"] and r["a"] == r["s"] for r in out.collect())


@pytest.mark.parametrize("boundary", ["include", "exclude", "half_open"])
def test_points_meet_parts_in_blocks(spark, monkeypatch, boundary):
    """Points and polygons of several parts with holes, block by block, against the expression for one pair; points on borders, repeated and null ones too."""
    rng = np.random.default_rng(6)
    square = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    slant = lambda x, y, r: [(x - r, y), (x, y - r), (x + r, y), (x, y + r), (x - r, y)]
    shapes = []
    for i in range(40):
        x, y, r = (float(v) for v in (rng.integers(0, 20), rng.integers(0, 20), 2 + i % 7))
        shapes.append((i // 2, [[square(x, y, r), slant(x, y, r / 2)], [slant(x + 3 * r, y, r)]][: 1 + i % 2]))
    shapes += [(90, None), (91, [])]
    places = [(n, float(rng.integers(-4, 60)) / 2, float(rng.integers(-4, 60)) / 2) for n in range(300)] + [(7, 3.0, 3.0), (400, None, 1.0)]
    points = spark.createDataFrame(places, "pid int, x double, y double").repartition(3)
    polygons = spark.createDataFrame(shapes, "id int, parts array<array<array<struct<x:double,y:double>>>>")
    polygons = R.with_bounds(polygons.withColumn("ring", R.parts_outline(F.col("parts")))).drop("ring")
    for name, value in {"POINTS": 16, "POLYGONS": 5, "EDGES": 50}.items():
        monkeypatch.setattr(SP, name, value)
    want = points.crossJoin(polygons).where(R.edges_hold(R.parts_edges(F.col("parts")), F.col("x"), F.col("y"), boundary)).select("id", "pid")
    joined = SP.join_points_polygons(points, polygons, 2.0, boundary=boundary)
    assert joined.columns == [*points.columns, *polygons.columns] and "MapInArrow" in _pairs_plan(joined)
    got = SP.join_points_polygons(points, polygons, 2.0, boundary=boundary, keep=["id", "pid"])
    rows = lambda df: sorted((r["id"], r["pid"]) for r in df.collect())
    assert rows(got) == rows(joined) == rows(want) and len(rows(got)) > 300
