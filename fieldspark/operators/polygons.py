"""Polygon editing on tables: clipping, splitting, dissolving, simplification.

Spark finds the candidate pairs and spreads the rows; numpy works on one pair or ring at a time inside the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.operators.overlay import each_key
from fieldspark.operators.spatial import join_polygons
from fieldspark.session import spread

_DIGITS = 9
RING_SQL = "array<struct<x:double,y:double>>"


# --- helpers on one ring ---------------------------------------------------------------------------------------------


Point = tuple[float, float]


def _points(ring) -> list[Point]:
    """Anticlockwise open ring without repeated vertices."""
    pts = [(p["x"], p["y"]) for p in ring]
    pts = [p for i, p in enumerate(pts) if p != pts[i - 1] or len(pts) == 1]
    return pts[::-1] if _area(pts) < 0 else pts


def _as_ring(pts) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def _area(pts) -> float:
    if len(pts) < 3:
        return 0.0
    x0, y0 = pts[0]
    total = 0.0
    for (ax, ay), (bx, by) in zip(pts[1:], pts[2:]):
        total += (ax - x0) * (by - y0) - (bx - x0) * (ay - y0)
    return total / 2


def _convex(pts: list[Point]) -> bool:
    n = len(pts)
    for i in range(n):
        (ax, ay), (bx, by), (cx, cy) = pts[i - 2], pts[i - 1], pts[i]
        if (bx - ax) * (cy - by) - (by - ay) * (cx - bx) < -1e-12:
            return False
    return n >= 3


def _keep_left(subject: list[Point], a: Point, b: Point) -> list[Point]:
    """Part of a ring on the left of the line from ``a`` to ``b``."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    out: list[Point] = []
    if not subject:
        return out
    p = subject[-1]
    sp = dx * (p[1] - a[1]) - dy * (p[0] - a[0])
    for q in subject:
        sq = dx * (q[1] - a[1]) - dy * (q[0] - a[0])
        if (sp >= 0) != (sq >= 0):
            t = sp / (sp - sq)
            out.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
        if sq >= 0:
            out.append(q)
        p, sp = q, sq
    return out


def _clip_convex(subject: list[Point], clip: list[Point]) -> list[Point]:
    """Subject cut by every edge of a convex anticlockwise ring; the area is right for any simple subject."""
    out = subject
    for i in range(len(clip)):
        out = _keep_left(out, clip[i - 1], clip[i])
    return out


def intersection_area_of(a: list[Point], b: list[Point]) -> float:
    if len(a) < 3 or len(b) < 3:
        return 0.0
    if _convex(b):
        return abs(_area(_clip_convex(a, b)))
    if _convex(a):
        return abs(_area(_clip_convex(b, a)))
    # signed triangle fans from the first vertex of each ring
    total = 0.0
    for ta, sa in _fan(a):
        for tb, sb in _fan(b):
            total += sa * sb * abs(_area(_clip_convex(ta, tb)))
    return abs(total)


def _fan(pts: list[Point]) -> list[tuple[list[Point], int]]:
    """Anticlockwise triangles from the first vertex, with the sign each had."""
    out = []
    for p, q in zip(pts[1:], pts[2:]):
        tri = [pts[0], p, q]
        signed = _area(tri)
        if signed:
            out.append((tri, 1) if signed > 0 else (tri[::-1], -1))
    return out


def _contains(ring: np.ndarray, p: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    straddle = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((straddle & (p[0] < x)).sum() % 2)


def _on_border(ring: np.ndarray, p: np.ndarray, eps: float) -> bool:
    a, d = ring, np.roll(ring, -1, axis=0) - ring
    t = np.clip(((p - a) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
    return bool((np.hypot(*(a + d * t[:, None] - p).T) <= eps).any())


def _split_at(ring: np.ndarray, other: np.ndarray, eps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Directed edges of ``ring`` cut wherever ``other`` meets them."""
    out = []
    oa, od = other, np.roll(other, -1, axis=0) - other
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        d = b - a
        length = math.hypot(*d)
        cuts = {0.0, 1.0}
        cross = d[0] * od[:, 1] - d[1] * od[:, 0]
        rel = oa - a
        for k in np.nonzero(np.abs(cross) > 1e-300)[0]:
            t = (rel[k, 0] * od[k, 1] - rel[k, 1] * od[k, 0]) / cross[k]
            u = (rel[k, 0] * d[1] - rel[k, 1] * d[0]) / cross[k]
            if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                cuts.add(float(min(1.0, max(0.0, t))))
        along = (rel @ d) / (length * length)
        off = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / length
        cuts.update(float(t) for t in along[(off <= eps) & (along > 0) & (along < 1)])
        at = sorted(cuts)
        pts = [a + d * t for t in at]
        out += [(p, q) for p, q in zip(pts, pts[1:]) if math.hypot(*(q - p)) > eps]
    return out


def _chain(edges: list[tuple[np.ndarray, np.ndarray]], eps: float, n_open: list[int] | None = None) -> list[np.ndarray]:
    """Rings from directed edges; at a branching vertex the sharpest left turn, which closes the smallest ring.

    Edges that close no ring are added up in ``n_open``.
    """

    def key(p):
        return (round(p[0] / (eps * 10)), round(p[1] / (eps * 10)))

    leaving: dict[tuple, list[int]] = {}
    for i, (p, _) in enumerate(edges):
        leaving.setdefault(key(p), []).append(i)
    used, rings = set(), []
    for start in range(len(edges)):
        if start in used:
            continue
        path, i = [], start
        while i is not None and i not in used:
            used.add(i)
            path.append(i)
            p, q = edges[i]
            heading = math.atan2(*(q - p)[::-1])
            options = [j for j in leaving.get(key(q), []) if j not in used]
            turn = lambda j: (math.atan2(*(edges[j][1] - edges[j][0])[::-1]) - heading + math.pi) % (2 * math.pi)
            i = max(options, key=turn) if options else None
        if key(edges[path[-1]][1]) == key(edges[path[0]][0]) and len(path) >= 3:
            rings.append(_drop_collinear(np.array([edges[j][0] for j in path])))
        elif n_open is not None:
            n_open[0] += len(path)
    return rings


def _drop_collinear(pts: np.ndarray) -> np.ndarray:
    a, b = pts - np.roll(pts, 1, axis=0), np.roll(pts, -1, axis=0) - pts
    cross = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    keep = cross > 1e-9 * np.hypot(*a.T) * np.hypot(*b.T)
    return pts[keep] if keep.sum() >= 3 else pts


def clip_parts(a: list[Point], b: list[Point]) -> list[list[Point]]:
    """Parts of the intersection of two simple anticlockwise rings, largest first."""
    if _convex(a) and _convex(b):
        part = _distinct(_clip_convex(a, b))
        return [part] if abs(_area(part)) > 0 else []
    return _overlay(np.array(a), np.array(b))


def _distinct(pts: list[Point]) -> list[Point]:
    return [p for i, p in enumerate(pts) if p != pts[i - 1]]


def _overlay(a: np.ndarray, b: np.ndarray) -> list[list[Point]]:
    """Edges of each ring cut at the other, kept where they bound the common area, and chained."""
    eps = 1e-10 * max(1.0, float(np.abs(np.concatenate([a, b])).max()))
    kept = []
    edges_b = _split_at(b, a, eps)
    for p, q in _split_at(a, b, eps):
        mid = (p + q) / 2
        if _on_border(b, mid, eps):
            same = any(((r + s) / 2 - mid) @ ((r + s) / 2 - mid) <= (4 * eps) ** 2 and (s - r) @ (q - p) > 0 for r, s in edges_b)
            if same:
                kept.append((p, q))
        elif _contains(b, mid):
            kept.append((p, q))
    for p, q in edges_b:
        mid = (p + q) / 2
        if not _on_border(a, mid, eps) and _contains(a, mid):
            kept.append((p, q))
    parts = [[tuple(map(float, v)) for v in r] for r in _chain(kept, eps)]
    return sorted((r for r in parts if abs(_area(r)) > 0), key=lambda r: -abs(_area(r)))


def simplify_ring(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas–Peucker on a ring, split at its first and farthest vertex; never below three vertices."""
    if len(pts) <= 3:
        return pts
    far = int(np.argmax(((pts - pts[0]) ** 2).sum(axis=1)))
    closed = np.vstack([pts, pts[:1]])
    keep = np.zeros(len(closed), bool)
    keep[[0, far, len(closed) - 1]] = True
    stack = [(0, far), (far, len(closed) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = closed[i], closed[j] - closed[i]
        inner = closed[i + 1 : j] - a
        length = math.hypot(*d)
        off = np.abs(inner[:, 0] * d[1] - inner[:, 1] * d[0]) / length if length else np.hypot(*inner.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    out = closed[:-1][keep[:-1]]
    return out if len(out) >= 3 else pts


# --- tables ----------------------------------------------------------------------------------------------------------


def _spread(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate pairs dealt out evenly before the Python step: a crowded grid cell does not stay in one task."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, *keys)


def _schema(df: DataFrame, extra: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])


def intersection_area(pairs: DataFrame, ring_a: str = "ring", ring_b: str = "ring_r", convex: bool = False) -> DataFrame:
    """Adds ``overlap``, the common area of two rings per row; ring columns are dropped.

    Where one of the rings is convex the area is a column expression; only pairs of two others go through Python. With ``convex`` the second
    ring is known to be convex, and the plan has no Python at all.
    """
    rest = [c for c in pairs.columns if c not in (ring_a, ring_b)]
    boxes = R.is_box(F.col(ring_a)) & R.is_box(F.col(ring_b))
    if convex:
        clipped = R.convex_overlap(R.anticlockwise(F.col(ring_a)), R.anticlockwise(F.col(ring_b)))
        return pairs.select(*rest, F.when(boxes, R.box_overlap(F.col(ring_a), F.col(ring_b))).otherwise(clipped).alias("overlap"))
    turned = pairs.withColumns({ring_a: R.anticlockwise(F.col(ring_a)), ring_b: R.anticlockwise(F.col(ring_b))})
    overlap = R.convex_overlap(F.col(ring_a), F.col(ring_b)).alias("overlap")
    sided = turned.withColumns({"_a": R.is_convex(F.col(ring_a)), "_b": R.is_convex(F.col(ring_b))})
    plain = sided.where("_a or _b").select(*rest, F.when(F.col("_b"), overlap).otherwise(R.convex_overlap(F.col(ring_b), F.col(ring_a))).alias("overlap"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            areas = [intersection_area_of(_points(a), _points(b)) for a, b in zip(pdf[ring_a], pdf[ring_b])]
            yield pdf[rest].assign(overlap=np.array(areas, float))

    hard = _spread(sided.where("not (_a or _b)").select(*rest, ring_a, ring_b), rest)
    return plain.union(hard.mapInPandas(run, _schema(pairs.select(*rest), "overlap double")))


def lone_boxes(key: str, parts: str) -> Column:
    """``boxes`` for ``parts_intersection_area``: null for geometries of other rings than upright rectangles, and where a key comes again or is null."""
    again = Window.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(parts)))
    alone = F.col(key).isNotNull() & (F.count(F.lit(1)).over(again) == 1)
    return F.when(alone, R.parts_boxes(F.col(parts)))


def parts_intersection_area(
    pairs: DataFrame, keys: list[str], parts_a: str = "parts", parts_b: str = "parts_r", convex: bool = False, boxes: tuple[str, str] | None = None
) -> DataFrame:
    """Common area of two geometries of several parts with holes: keys, ``overlap``.

    The rings of both meet in pairs; a pair of an outer ring and a hole counts negative, as holes lie inside their outer ring. ``boxes``: columns of
    ``lone_boxes``, made on each side before it was paired. Where both are given, a pair is a row of the result: it is neither
    taken apart into rings nor shuffled. What else there is, is told by one side alone, so Spark drops it before the join.
    """

    def rings(parts: str, name: str) -> Column:
        signed = F.flatten(F.transform(parts, lambda part: F.transform(part, lambda r, i: F.struct(r.alias("ring"), F.when(i == 0, 1.0).otherwise(-1.0).alias("sign")))))
        return F.explode(signed).alias(name)

    if boxes:
        a, b = (F.col(c) for c in boxes)
        plain = pairs.where(a.isNotNull() & b.isNotNull()).select(*keys, R.boxes_overlap(a, b).alias("overlap"))
        rest = pairs.where(a.isNull()).union(pairs.where(a.isNotNull() & b.isNull()))
        return plain.union(parts_intersection_area(rest, keys, parts_a, parts_b, convex))
    one = pairs.select(*keys, parts_b, rings(parts_a, "a")).select(*keys, "a", rings(parts_b, "b"))
    flat = one.select(*keys, F.col("a.ring").alias("ring"), F.col("b.ring").alias("ring_r"), (F.col("a.sign") * F.col("b.sign")).alias("_sign"))
    return intersection_area(flat, convex=convex).groupBy(*keys).agg(F.sum(F.col("_sign") * F.col("overlap")).alias("overlap"))


def max_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str, cell: float, convex: bool = False) -> DataFrame:
    """Per left polygon the intersecting right polygon with the largest common area; ties by key. ``convex``: the right ones are.

    Equal shapes share their answer, so distinct shapes meet, each right one with its first key.
    """
    shape = ["ring", "minx", "miny", "maxx", "maxy"]
    firsts = right.groupBy(*shape).agg(F.min(right_key).alias(right_key))
    pairs = join_polygons(left.select(*shape).distinct(), firsts, cell).select(F.col("ring").alias("_shape"), right_key, "ring", "ring_r")
    order = F.struct(F.col("overlap"), -F.col(right_key))
    best = lambda df, key: df.groupBy(key).agg(F.max_by(right_key, order).alias(right_key), F.max("overlap").alias("overlap"))
    by_shape = best(intersection_area(pairs, convex=convex), "_shape")
    return best(left.select(left_key, F.col("ring").alias("_shape")).join(by_shape, "_shape"), left_key)


def clip_polygons(pairs: DataFrame, ring: str = "ring", by: str = "ring_r") -> DataFrame:
    """Replaces ``ring`` by the largest part of its intersection with ``by``; unchanged when they do not meet. Only pairs of other rings than
    upright rectangles go through Python."""
    rest = [c for c in pairs.columns if c not in (ring, by)]
    x0, y0, x1, y1 = R.common_box(F.col(ring), F.col(by))
    boxes, meet = R.is_box(F.col(ring)) & R.is_box(F.col(by)), (x0 < x1) & (y0 < y1)
    plain = pairs.where(boxes).select(*rest, F.when(meet, R.rectangle(x0, y0, x1, y1)).otherwise(F.col(ring)).cast(RING_SQL).alias(ring), meet.alias("clipped"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rings, flags = [], []
            for a, b in zip(pdf[ring], pdf[by]):
                parts = clip_parts(_points(a), _points(b))
                rings.append(_as_ring(parts[0]) if parts else a)
                flags.append(bool(parts))
            yield pdf[rest].assign(**{ring: rings, "clipped": flags})

    # told by one ring alone each, so Spark drops the rectangles before the pairs are made
    odd = pairs.where(~R.is_box(F.col(ring))).union(pairs.where(R.is_box(F.col(ring)) & ~R.is_box(F.col(by))))
    return plain.union(_spread(odd, rest).mapInPandas(run, _schema(pairs.select(*rest), f"{ring} {RING_SQL}, clipped boolean")))


def samples_inside(ring: Column, ax: Column, ay: Column, bx: Column, by: Column, n: int = 20) -> Column:
    """How many of ``n + 1`` evenly spaced points of a line fall inside the ring."""
    steps = F.sequence(F.lit(0), F.lit(n))
    at = lambda i: (ax + (bx - ax) * i / n, ay + (by - ay) * i / n)
    return R.let(R.edges(ring), lambda es: F.size(F.filter(steps, lambda i: R.edges_hold(es, *at(i)))))


def split_by_lines(
    polygons: DataFrame, lines: DataFrame, key: str, cell: float, min_area: float, min_samples: int = 2
) -> DataFrame:
    """One row per part: ``key, part, ring``. ``lines``: ``ax, ay, bx, by``.

    The line is extended across the polygon and cuts it into two half planes. A polygon is cut only where at least
    ``min_samples`` of 21 points of the drawn line lie inside; parts below ``min_area`` are left out; a polygon hit by
    several lines is cut by them in order of ``line_id``. Polygons that no line divides come back whole as part 0.
    Of equal lines only the first cuts, as no later one divides a part again.
    """
    lines = lines.groupBy("ax", "ay", "bx", "by").agg(F.min("line_id").alias("line_id"))
    boxed = lines.select(
        "line_id", "ax", "ay", "bx", "by",
        R.rectangle(F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")).alias("ring"),
        F.least("ax", "bx").alias("minx"), F.least("ay", "by").alias("miny"),
        F.greatest("ax", "bx").alias("maxx"), F.greatest("ay", "by").alias("maxy"),
    )
    base = polygons.select(key, "ring", "minx", "miny", "maxx", "maxy")
    hits = join_polygons(base, boxed, cell, touching=False).filter(
        samples_inside(F.col("ring"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) >= min_samples
    )
    cuts = hits.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("line_id", "ax", "ay", "bx", "by"))),
            lambda s: F.struct(s["ax"], s["ay"], s["bx"], s["by"]),
        ).alias("cuts")
    )
    todo = base.select(key, "ring").join(cuts, key, "left")
    schema = f"`{key}` {dict(polygons.dtypes)[key]}, part int, ring {RING_SQL}, area double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, ring, lines_of in zip(pdf[key], pdf["ring"], pdf["cuts"]):
                parts = [_points(ring)]
                for cut in lines_of if lines_of is not None else []:
                    line = [(cut["ax"], cut["ay"]), (cut["bx"], cut["by"])]
                    parts = [piece for p in parts for piece in _halves(p, line, min_area)]
                rows += [(k, i, _as_ring(p), abs(_area(p))) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[key, "part", "ring", "area"])

    return _spread(todo, [key]).mapInPandas(run, schema)


def _halves(pts: list[Point], line: list[Point], min_area: float) -> list[list[Point]]:
    a, b = line
    d = (b[0] - a[0], b[1] - a[1])
    length = math.hypot(*d)
    if length < 1e-12:
        return [pts]
    if _convex(pts):
        parts = [_distinct(_keep_left(pts, a, b)), _distinct(_keep_left(pts, b, a))]
    else:
        # half planes as rectangles that reach far beyond the polygon
        span = max(math.hypot(x - a[0], y - a[1]) for x, y in pts) + length
        u = (d[0] / length * 3 * span, d[1] / length * 3 * span)
        p, q, n = (a[0] - u[0], a[1] - u[1]), (b[0] + u[0], b[1] + u[1]), (-u[1], u[0])
        left = [p, q, (q[0] + n[0], q[1] + n[1]), (p[0] + n[0], p[1] + n[1])]
        right = [q, p, (p[0] - n[0], p[1] - n[1]), (q[0] - n[0], q[1] - n[1])]
        parts = clip_parts(pts, left) + clip_parts(pts, right)
    parts = [p for p in parts if abs(_area(p)) >= min_area]
    return parts if len(parts) >= 2 else [pts]


def dissolve_adjacent(pieces: DataFrame, key: str, name: str = "nombre", order: str = "pos") -> DataFrame:
    """Union of the adjacent, non-overlapping pieces of each key by cancelling shared borders.

    Whole shared edges cancel in a distributed aggregation; only the remaining border is chained, one key at a time.
    ``rings`` holds every ring of the result, outer ones anticlockwise and holes clockwise, the largest first (also as ``ring``); ``area``
    is that of all pieces without the holes; ``n_open`` counts border edges that close no ring.
    ``status``: ``ok`` for one ring, ``needs_closing`` when the pieces leave a gap, a hole or an open border, or touch only at points.
    """
    labels = pieces.groupBy(key).agg(
        F.concat_ws(" + ", F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda s: s[name])).alias("nombre"),
        F.sum(R.area(F.col("ring"))).alias("area_sum"),
        F.count(F.lit(1)).alias("n_piezas"),
    )
    turned = F.when(R.signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring"))
    edges = spread(pieces.select(key, turned.alias("_r"))).select(key, F.explode(R.edges(F.col("_r"))).alias("e")).select(
        key,
        *[F.round(F.col(f"e.{p}.{v}"), _DIGITS).alias(f"{p}{v}") for p in "ab" for v in "xy"],
    ).filter("ax <> bx OR ay <> by")
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    ends = [
        F.when(forward, F.col(f"{p}{v}")).otherwise(F.col(f"{q}{v}")).alias(f"{p}{v}")
        for p, q in (("a", "b"), ("b", "a"))
        for v in "xy"
    ]
    left = (
        edges.select(key, *ends, F.when(forward, 1).otherwise(-1).alias("_s"))
        .groupBy(key, "ax", "ay", "bx", "by")
        .agg(F.sum("_s").alias("_s"))
        .filter("_s <> 0")
    )

    def chained(edges: np.ndarray) -> dict:
        flip = edges[:, 4:] < 0
        a, b = np.where(flip, edges[:, 2:4], edges[:, :2]), np.where(flip, edges[:, :2], edges[:, 2:4])
        n_open = [0]
        rings = _chain(_cancel(a, b), 1e-10 * max(1.0, float(np.abs(a).max())), n_open)
        rings.sort(key=lambda r: -abs(_area(r)))
        every = [_as_ring(r) for r in rings]
        return {"ring": every[0] if every else [], "rings": every, "area": abs(sum(_area(r) for r in rings)), "n_rings": len(rings), "n_open": n_open[0]}

    extra = f"ring {RING_SQL}, rings array<{RING_SQL}>, area double, n_rings int, n_open int"
    merged = each_key(left, [key], ["ax", "ay", "bx", "by", "_s"], chained, extra)
    status = F.when((F.col("n_rings") == 1) & (F.col("n_open") == 0) & (F.col("area") >= 0.85 * F.col("area_sum")), "ok").otherwise("needs_closing")
    return labels.join(merged, key).withColumn("status", status)


def _cancel(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Cuts edges at vertices of other edges that lie on them, then removes opposite pairs."""
    vertices = np.unique(np.vstack([a, b]), axis=0)
    signed: dict[tuple, int] = {}
    some = max(1, 2**16 // len(vertices))
    for begin in range(0, len(a), some):
        p, d = a[begin : begin + some], (b - a)[begin : begin + some]
        length = np.hypot(d[:, 0], d[:, 1])[:, None]
        rx, ry = vertices[:, 0] - p[:, :1], vertices[:, 1] - p[:, 1:]
        t = (rx * d[:, :1] + ry * d[:, 1:]) / (length * length)
        off = np.abs(rx * d[:, 1:] - ry * d[:, :1]) / length
        which, at = np.nonzero((off <= 1e-9) & (t > 1e-12) & (t < 1 - 1e-12))
        # start, vertices on the edge and end of every edge, in order
        edge = np.concatenate([np.arange(len(p)), which, np.arange(len(p))])
        share = np.concatenate([np.zeros(len(p)), t[which, at], np.ones(len(p))])
        order = np.lexsort((share, edge))
        edge, share = edge[order], share[order]
        points = list(map(tuple, np.round(p[edge] + d[edge] * share[:, None], _DIGITS).tolist()))
        for u, v, same in zip(points, points[1:], (edge[1:] == edge[:-1]).tolist()):
            if same and u != v:
                signed[(min(u, v), max(u, v))] = signed.get((min(u, v), max(u, v)), 0) + (1 if u < v else -1)
    return [
        (np.array(u if s > 0 else v), np.array(v if s > 0 else u)) for (u, v), s in signed.items() for _ in range(abs(s))
    ]


def simplify_polygons(polygons: DataFrame, tolerance: float = 0.00005) -> DataFrame:
    """Rings within the tolerance of the original; adds ``n_before`` and ``n_after``."""
    rest = [c for c in polygons.columns if c != "ring"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [_points(r) for r in pdf["ring"]]
            slim = [simplify_ring(np.array(p), tolerance) for p in raw]
            yield pdf[rest].assign(
                ring=[_as_ring(p) for p in slim], n_before=[len(p) for p in raw], n_after=[len(p) for p in slim]
            )

    return polygons.mapInPandas(run, _schema(polygons.select(*rest), f"ring {RING_SQL}, n_before int, n_after int"))


def shared_border(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Length of the border two rings have in common."""

    def overlap(p: Column, q: Column) -> Column:
        dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
        length = F.sqrt(dx * dx + dy * dy)

        def along(v: Column) -> Column:
            return ((v["x"] - p["a"]["x"]) * dx + (v["y"] - p["a"]["y"]) * dy) / length

        def off(v: Column) -> Column:
            return F.abs((v["x"] - p["a"]["x"]) * dy - (v["y"] - p["a"]["y"]) * dx) / length

        s, t = along(q["a"]), along(q["b"])
        common = F.least(length, F.greatest(s, t)) - F.greatest(F.lit(0.0), F.least(s, t))
        same_line = (length > 0) & (off(q["a"]) <= tolerance) & (off(q["b"]) <= tolerance)
        return F.when(same_line, F.greatest(F.lit(0.0), common)).otherwise(F.lit(0.0))

    def total(eb: Column) -> Column:
        return F.aggregate(
            R.edges(a), F.lit(0.0), lambda acc, p: acc + F.aggregate(eb, F.lit(0.0), lambda s, q: s + overlap(p, q))
        )

    return R.let(R.edges(b), total)


def best_neighbor(pieces: DataFrame, key: str, cell: float, within: str) -> DataFrame:
    """Per piece the piece of the same ``within`` that shares most border; ties by key."""
    right = pieces.select(F.col(key).alias("vecino"), F.col(within).alias("_w"), "ring", "minx", "miny", "maxx", "maxy")
    pairs = join_polygons(pieces, right, cell, touching=False).filter(
        (F.col(within) == F.col("_w")) & (F.col(key) != F.col("vecino"))
    )
    scored = pairs.withColumn("borde", shared_border(F.col("ring"), F.col("ring_r"))).filter("borde > 0")
    order = F.struct(F.col("borde"), -F.col("vecino"))
    return scored.groupBy(key).agg(F.max_by("vecino", order).alias("vecino"), F.max("borde").alias("borde"))


def validate_subplots(subplots: DataFrame, plots: DataFrame, cell: float, tolerance: float = 0.0001) -> DataFrame:
    """One row per subplot with its rule columns, a default name and hectares to two decimals.

    ``subplots``: ``id_recinto, pos, nombre, ring``; overlaps are measured between neighbours that share a grid cell.
    """
    s = R.with_bounds(subplots.withColumn("ring", R.make_valid(F.col("ring")))).join(
        plots.select("id_recinto", F.col("ring").alias("_plot")), "id_recinto", "left"
    )
    other = s.filter("ring IS NOT NULL").select(
        F.col("id_recinto").alias("_o"), F.col("pos").alias("_p"), "ring", "minx", "miny", "maxx", "maxy"
    )
    mine = s.filter("ring IS NOT NULL").select("id_recinto", "pos", "ring", "minx", "miny", "maxx", "maxy")
    close = join_polygons(mine, other, cell).filter((F.col("id_recinto") == F.col("_o")) & (F.col("pos") < F.col("_p")))
    clash = (
        intersection_area(close.select("id_recinto", "pos", "_p", "ring", "ring_r"))
        .filter("overlap > 1e-10")
        .select("id_recinto", F.explode(F.array("pos", "_p")).alias("pos"))
        .distinct()
        .withColumn("_clash", F.lit(True))
    )
    inside = R.covered_by_tolerance(F.col("ring"), F.col("_plot"), tolerance)
    name = F.coalesce(F.when(F.trim("nombre") != "", F.trim("nombre")), F.concat(F.lit("Subparcela "), F.col("pos").cast("string")))
    return s.join(clash, ["id_recinto", "pos"], "left").select(
        "id_recinto",
        "pos",
        name.alias("nombre"),
        (F.col("ring").isNotNull() & (R.area(F.col("ring")) > 0)).alias("ok_valida"),
        F.coalesce(R.is_simple(F.col("ring")), F.lit(False)).alias("ok_simple"),
        F.coalesce(inside, F.lit(False)).alias("ok_dentro"),
        F.col("_clash").isNull().alias("ok_sin_solape"),
        F.round(R.area(F.col("ring")) / 10000.0, 2).alias("superficie_ha"),
    )


def dissolve_union(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Union per key of parts that do not overlap: total area, part count and the box."""
    return R.with_bounds(parts).groupBy(*keys).agg(
        F.sum(R.area(F.col("ring"))).alias("area"),
        F.count(F.lit(1)).alias("n_partes"),
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )
