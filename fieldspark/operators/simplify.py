"""Simplification that keeps neighbours together and rings apart.

Borders are cut at nodes, the points where more than two different sides meet, into arcs. A border that two polygons share is the same arc
on both sides, is simplified once, from the same end, and so stays the same. Arcs that would then cross or touch another one go back to their
full shape, round by round, until none does.

Rings, points and arcs are rows; a task holds one ring, one arc, or what lies in one grid cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.overlay import GRAIN, _schema, as_points, grain_for, snapped
from fieldspark.session import cut_lineage, spread

POINTS = "array<struct<x:long,y:long>>"
RING_SQL = "array<struct<x:double,y:double>>"


def douglas_peucker(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of an open line stay: its ends, and all that lie farther off than the tolerance; closed lines are split at the farthest point."""
    keep = np.zeros(len(pts), bool)
    keep[[0, -1]] = True
    stack = [(0, len(pts) - 1)]
    if (pts[0] == pts[-1]).all() and len(pts) > 3:
        far = int(((pts - pts[0]) ** 2).sum(1).argmax())
        keep[far] = True
        stack = [(0, far), (far, len(pts) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = pts[i], pts[j] - pts[i]
        inner = pts[i + 1 : j] - a
        length2 = float(d @ d)
        share = np.clip(inner @ d / length2, 0, 1) if length2 else np.zeros(len(inner))
        off = np.hypot(*(inner - share[:, None] * d).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def _merged(df: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: rings become points, points sides, sides cells, but Spark judges their size by the input file's."""
    return df.hint("shuffle_merge")


def _cells(df: DataFrame, step: int, names: tuple[str, ...] = ("ax", "ay", "bx", "by")) -> DataFrame:
    """One row for each grid cell that the box of a side covers: adds _cx, _cy."""
    ax, ay, bx, by = (F.col(c) for c in names)
    at = lambda v: F.floor(v / F.lit(step)).cast("long")
    return df.withColumn("_cx", F.explode(F.sequence(at(F.least(ax, bx) - 1), at(F.greatest(ax, bx) + 1)))).withColumn(
        "_cy", F.explode(F.sequence(at(F.least(ay, by) - 1), at(F.greatest(ay, by) + 1)))
    )


def _sides(rings: DataFrame) -> DataFrame:
    """rid, seq, ax, ay, bx, by of closed point lists."""
    pairs = F.zip_with(F.slice("pts", F.lit(1), F.size("pts") - 1), F.slice("pts", F.lit(2), F.size("pts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rings.select("rid", F.posexplode(pairs).alias("seq", "e")).select("rid", "seq", *[F.col(f"e.{p}.{v}").alias(p + v) for p in "ab" for v in "xy"])


def _with_touching_points(rings: DataFrame, step: int) -> DataFrame:
    """Rings with the vertices of others that lie on their sides put in, so that borders shared in part have equal points."""
    sides = _sides(rings)
    points = sides.select(F.col("ax").alias("px"), F.col("ay").alias("py")).distinct()
    placed = points.withColumns({"_cx": F.floor(F.col("px") / step).cast("long"), "_cy": F.floor(F.col("py") / step).cast("long")})
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ex, ey = F.col("px") - F.col("ax"), F.col("py") - F.col("ay")
    along, length2 = (ex * dx + ey * dy).cast("double"), (dx * dx + dy * dy).cast("double")
    off = F.abs((dx * ey - dy * ex).cast("double"))
    near = (off < 0.75 * F.sqrt(length2)) & (along > 0) & (along < length2)
    met = _cells(sides, step).join(_merged(placed), ["_cx", "_cy"]).where(near)
    extra = met.select("rid", "seq", (along / length2).alias("t"), "px", "py").distinct()
    base = sides.select("rid", "seq", F.lit(0.0).alias("t"), F.col("ax").alias("px"), F.col("ay").alias("py"))
    # the points of one ring
    joined = base.union(extra).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("seq", "t", F.col("px").alias("x"), F.col("py").alias("y")))).alias("p"))
    pts = F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return joined.select("rid", pts.alias("pts")).select("rid", F.concat("pts", F.slice("pts", 1, 1)).alias("pts"))


def _nodes(rings: DataFrame) -> DataFrame:
    """Points where more than two different sides meet."""
    s = _sides(rings)
    ends = s.select(F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("bx").alias("nx"), F.col("by").alias("ny")).union(
        s.select(F.col("bx").alias("x"), F.col("by").alias("y"), F.col("ax").alias("nx"), F.col("ay").alias("ny"))
    )
    return ends.distinct().groupBy("x", "y").count().where("count > 2").select("x", "y")


def _arc_name(pts: np.ndarray) -> bytes:
    return hashlib.md5(np.ascontiguousarray(pts, np.int64).tobytes()).digest()


def _cut_arcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """rid, pos, arc, turned, points: the arcs of each ring in order, each written from its smaller end."""
    for pdf in batches:
        out = []
        for rid, pts, nodes in zip(pdf["rid"], pdf["pts"], pdf["nodes"]):
            p = np.array([(v["x"], v["y"]) for v in pts], np.int64)[:-1]
            at = np.array(sorted(nodes), int) if nodes is not None and len(nodes) else np.array([int(np.lexsort((p[:, 1], p[:, 0]))[0])])
            p = np.roll(p, -at[0], axis=0)
            cuts = np.append(at - at[0], len(p))
            closed = np.vstack([p, p[:1]])
            for pos, (i, j) in enumerate(zip(cuts, cuts[1:])):
                arc = closed[i : j + 1]
                turned = arc[::-1].tolist() < arc.tolist()
                arc = arc[::-1] if turned else arc
                out.append((rid, pos, _arc_name(arc), bool(turned), [{"x": int(x), "y": int(y)} for x, y in arc]))
        yield pd.DataFrame(out, columns=["rid", "pos", "arc", "turned", "points"])


def _simplified(tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slim = []
            for points in pdf["points"]:
                p = np.array([(v["x"], v["y"]) for v in points], np.int64)
                keep = douglas_peucker(p.astype(np.float64), tolerance)
                if (p[0] == p[-1]).all() and keep.sum() < 4:  # a ring keeps three corners
                    keep[:] = True
                slim.append([{"x": int(x), "y": int(y)} for x, y in p[keep]])
            yield pdf[["arc"]].assign(slim=slim, whole=[len(a) == len(b) for a, b in zip(slim, pdf["points"])])

    return run


def _clashing(shapes: DataFrame, step: int) -> DataFrame:
    """arc: the simplified arcs of which a side meets another side elsewhere than in a common end."""
    pairs = F.zip_with(F.slice("pts", F.lit(1), F.size("pts") - 1), F.slice("pts", F.lit(2), F.size("pts") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = shapes.select("arc", "whole", F.posexplode(pairs).alias("seq", "e")).select("arc", "whole", "seq", *[F.col(f"e.{p}.{v}").alias(p + v) for p in "ab" for v in "xy"])
    left = _cells(sides, step)
    right = left.withColumnsRenamed({c: f"{c}_r" for c in sides.columns})

    def side(px, py, qx, qy, x, y):
        cross = (F.col(qx) - F.col(px)) * (F.col(y) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(x) - F.col(px))
        return F.signum(cross.cast("double"))

    s1, s2 = side("ax", "ay", "bx", "by", "ax_r", "ay_r"), side("ax", "ay", "bx", "by", "bx_r", "by_r")
    s3, s4 = side("ax_r", "ay_r", "bx_r", "by_r", "ax", "ay"), side("ax_r", "ay_r", "bx_r", "by_r", "bx", "by")
    same = lambda p, q: (F.col(f"{p}x") == F.col(f"{q}x_r")) & (F.col(f"{p}y") == F.col(f"{q}y_r"))
    common = sum(same(p, q).cast("int") for p in "ab" for q in "ab")
    boxes = F.lit(True)
    for v in "xy":
        boxes = boxes & (F.least(f"a{v}", f"b{v}") <= F.greatest(f"a{v}_r", f"b{v}_r")) & (F.greatest(f"a{v}", f"b{v}") >= F.least(f"a{v}_r", f"b{v}_r"))
    meet = boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)
    # with a common end two sides clash only if they lie on each other
    straight = (s1 == 0) & (s2 == 0)
    dot = (F.col("bx") - F.col("ax")) * (F.col("bx_r") - F.col("ax_r")) + (F.col("by") - F.col("ay")) * (F.col("by_r") - F.col("ay_r"))
    outward = F.when(same("a", "a") | same("b", "b"), dot > 0).otherwise(dot < 0)
    clash = F.when(common == 0, meet).when(common == 1, straight & outward).otherwise(F.lit(True))
    other = (F.col("arc") != F.col("arc_r")) | (F.col("seq") != F.col("seq_r"))
    hits = left.join(_merged(right), ["_cx", "_cy"]).where(other & clash & ~F.col("whole"))
    return hits.select("arc").distinct()


def simplify_together(polygons: DataFrame, tolerance: float, cell: float, ring: str = "ring", grain: float = GRAIN) -> DataFrame:
    """Replaces ``ring`` by one within the tolerance; adds ``n_before`` and ``n_after``. Null rings stay null.

    Borders that rings share stay shared, also where one polygon's corner lies on another's side. No side crosses, touches or covers another one
    unless the input's did. ``cell`` should be some sides long.
    """
    grain = grain_for(cell, grain)
    step = 2 * max(1, round(cell / grain))
    numbered = cut_lineage(spread(polygons).withColumn("_rid", F.monotonically_increasing_id()))
    rest = [c for c in polygons.columns if c not in (ring, "n_before", "n_after")]

    def to_points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rings = [snapped(r, grain) for r in pdf["ring"]]
            rings = [r[np.concatenate(([True], (r[1:] != r[:-1]).any(1)))] if len(r) else r for r in rings]
            rings = [r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r for r in rings]
            good = np.array([len(r) >= 3 for r in rings], bool)
            closed = [[{"x": int(x), "y": int(y)} for x, y in np.vstack([r, r[:1]])] for r, g in zip(rings, good) if g]
            yield pd.DataFrame({"rid": pdf["rid"].to_numpy()[good], "pts": closed})

    given = numbered.where(F.col(ring).isNotNull()).select(F.col("_rid").alias("rid"), F.col(ring).alias("ring"))
    points = cut_lineage(given.mapInPandas(to_points, f"rid long, pts {POINTS}"))  # read for sides and for corners
    rings = cut_lineage(_with_touching_points(points, step))
    corners = rings.select("rid", F.posexplode(F.slice("pts", F.lit(1), F.size("pts") - 1)).alias("i", "p")).select("rid", "i", "p.x", "p.y")
    nodes = corners.join(_merged(_nodes(rings)), ["x", "y"]).groupBy("rid").agg(F.collect_list("i").alias("nodes"))
    pieces = cut_lineage(rings.join(_merged(nodes), "rid", "left").mapInPandas(_cut_arcs, f"rid long, pos int, arc binary, turned boolean, points {POINTS}"))
    arcs = pieces.groupBy("arc").agg(F.first("points").alias("points"))  # equal names, equal points
    slim = arcs.mapInPandas(_simplified(tolerance / grain * 2), f"arc binary, slim {POINTS}, whole boolean")
    shapes = cut_lineage(arcs.join(_merged(slim), "arc").select("arc", F.col("slim").alias("pts"), "whole", "points"))
    while True:
        clashing = cut_lineage(_clashing(shapes, step))
        if clashing.isEmpty():
            break
        back = shapes.join(_merged(clashing.withColumn("_back", F.lit(True))), "arc", "left")
        again = F.coalesce("_back", F.lit(False))
        shapes = cut_lineage(back.select("arc", F.when(again, F.col("points")).otherwise(F.col("pts")).alias("pts"), (F.col("whole") | again).alias("whole"), "points"))
    used = pieces.select("rid", "pos", "arc", "turned").join(_merged(shapes.select("arc", "pts")), "arc")
    line = F.when(F.col("turned"), F.reverse("pts")).otherwise(F.col("pts"))
    rebuilt = used.select("rid", "pos", F.slice(line, F.lit(1), F.size("pts") - 1).alias("pts")).groupBy("rid").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pts"))), lambda v: v["pts"])).alias("pts")
    )
    half = F.lit(grain / 2)
    out = rebuilt.select("rid", F.transform("pts", lambda p: F.struct((p["x"] * half).alias("x"), (p["y"] * half).alias("y"))).alias("_new"))
    joined = numbered.withColumn("n_before", F.size(ring)).join(_merged(out), F.col("_rid") == F.col("rid"), "left")
    return joined.select(*rest, F.when(F.col(ring).isNotNull(), F.coalesce("_new", F.col(ring))).alias(ring), "n_before", F.when(F.col(ring).isNotNull(), F.size(F.coalesce("_new", F.col(ring)))).alias("n_after"))
