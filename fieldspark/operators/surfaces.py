"""Fitted surfaces: radial basis, Gaussian process and triangulation, one fit per group of stations.

A group is one variable on one date, so it holds at most one row per station. Fits of all groups run in parallel, each group in a task
of its own; evaluation is a join of cells with the packed coefficients. Up to ``DIRECT`` nodes a fit is one dense system. Larger ones never
hold a matrix of all pairs: the radial basis is solved by iteration, the Gaussian process in the kernel's own coordinates, whose number
depends on the length scale and not on the nodes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.operators.interpolation import SALTS
from fieldspark.operators.spatial import join_points_polygons
from fieldspark.session import cut_lineage

# Hyperparameters tried by the Gaussian process (length scales relative to the extent).
LENGTH_SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
SIGNAL_LEVELS = (0.1, 1.0, 10.0, 100.0)
NOISE_LEVELS = (0.01, 0.1, 1.0, 10.0)
#: Nodes of a fit that is solved as one dense system.
DIRECT = 2048
#: Distances, and numbers of a wide matrix, that a task has at a time, about: the first fit into its cache.
AT_ONCE, WIDE = 2**16, 2**21
#: Neighbours and far nodes along a side that a cardinal function is made of; residual at which the iteration ends, and its most steps.
NEAR, FAR, RESIDUAL, STEPS = 60, 4, 1e-11, 400
#: Share of the noise below which a direction of the kernel is left out.
NEGLIGIBLE = 1e-7
#: Tasks that groups are dealt out to: few small rows would otherwise meet in one.
FIT_TASKS = 256


def _fit_schema(df: DataFrame, group: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{g}` {types[g]}" for g in group), "x double, y double, w double, scale double"])


def _per_position(stations: DataFrame, group: list[str]) -> DataFrame:
    """Stations at one position count once, with their mean: equal positions have no unique fit."""
    return stations.groupBy(*group, "x", "y").agg(F.avg("valor").alias("valor"))


def _fit_each(stations: DataFrame, group: list[str], fit, schema: str) -> DataFrame:
    tasks = max(FIT_TASKS, int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _per_position(stations, group).repartition(tasks, *group).groupBy(*group).applyInPandas(fit, schema)


def _stretches(n: int, width: int, at_once: int = AT_ONCE) -> list[slice]:
    """Rows of a matrix of so many columns, some numbers at a time."""
    rows = max(1, at_once // max(width, 1))
    return [slice(i, min(i + rows, n)) for i in range(0, n, rows)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of two sets of points."""
    d2 = np.subtract.outer(a[:, 0], b[:, 0])
    d2 *= d2
    dy = np.subtract.outer(a[:, 1], b[:, 1])
    dy *= dy
    d2 += dy
    return d2


def _multiquadric(d2: np.ndarray) -> np.ndarray:
    d2 += 1.0
    return np.sqrt(d2, out=d2)


def _cardinal(pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each node a combination of its neighbours and some nodes spread over the extent that is 1 at the node and 0 at the others: node numbers
    and their weights. As a whole these are nearly the inverse of the system."""
    n, k = len(pts), min(NEAR, len(pts) - 1)
    low, sides = pts.min(axis=0), np.ptp(pts, axis=0)
    marks = [low + sides * (u, v) for u in np.linspace(0, 1, FAR) for v in np.linspace(0, 1, FAR)]
    far = np.unique([int(((pts - m) ** 2).sum(axis=1).argmin()) for m in marks])
    near = np.empty((n, k), np.int64)
    for some in _stretches(n, n):
        near[some] = np.argpartition(_squares(pts[some], pts), k, axis=1)[:, :k]
    members = np.hstack([near, np.broadcast_to(far, (n, len(far)))])
    weights = np.empty(members.shape)
    for some in _stretches(n, members.shape[1] ** 2, WIDE):
        own = members[some]
        q = pts[own]
        a = np.sqrt(((q[:, :, None] - q[:, None]) ** 2).sum(axis=3) + 1.0)
        row, at = np.nonzero((own[:, :k, None] == far).any(axis=1))  # a far node that is a neighbour too stands in the system once
        a[row, k + at, :] = 0.0
        a[row, :, k + at] = 0.0
        a[row, k + at, k + at] = 1.0
        one = (own == np.arange(some.start, some.stop)[:, None]).astype(float)
        one[:, k:] = np.where((own[:, :k] == np.arange(some.start, some.stop)[:, None]).any(axis=1)[:, None], 0.0, one[:, k:])
        weights[some] = np.linalg.solve(a, one[:, :, None])[:, :, 0]
    return members, weights


def multiquadric_weights(pts: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Solves the multiquadric system (scale 1) by minimal residuals over local cardinal functions; only stretches of the matrix exist at a time."""
    n = len(pts)
    members, weights = _cardinal(pts)

    def spread_out(u: np.ndarray) -> np.ndarray:
        return np.bincount(members.ravel(), weights=(weights * u[:, None]).ravel(), minlength=n)

    def at_nodes(w: np.ndarray) -> np.ndarray:
        return np.concatenate([_multiquadric(_squares(pts[some], pts)) @ w for some in _stretches(n, n)])

    size = float(np.linalg.norm(v))
    if size == 0:
        return np.zeros(n)
    w, goal = np.zeros(n), RESIDUAL * size
    for _ in range(STEPS // 100):
        rest = v - at_nodes(w) if w.any() else v
        begin = float(np.linalg.norm(rest))
        if begin <= 100 * goal:  # what the recurrence promises, but for rounding
            return w
        basis, h = [rest / begin], np.zeros((101, 100))
        for j in range(100):
            u = at_nodes(spread_out(basis[j]))
            for _ in range(2):
                for i, b in enumerate(basis):
                    share = b @ u
                    h[i, j] += share
                    u = u - share * b
            h[j + 1, j] = np.linalg.norm(u)
            first = np.zeros(j + 2)
            first[0] = begin
            y = np.linalg.lstsq(h[: j + 2, : j + 1], first, rcond=None)[0]
            if np.linalg.norm(first - h[: j + 2, : j + 1] @ y) <= goal or h[j + 1, j] == 0:
                break
            basis.append(u / h[j + 1, j])
        w = w + spread_out(np.array(basis[: len(y)]).T @ y)
    if np.linalg.norm(v - at_nodes(w)) > 1e-6 * size:
        raise RuntimeError("the radial basis did not settle")
    return w


def rbf_fit(stations: DataFrame, group: list[str]) -> DataFrame:
    """Multiquadric weights; the scale is the mean spacing of the nodes."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = pdf[["x", "y"]].to_numpy(float)
        sides = pts.max(axis=0) - pts.min(axis=0)
        sides = sides[sides > 0]
        scale = float((np.prod(sides) / len(pts)) ** (1.0 / len(sides))) if len(sides) else 1.0
        v = pdf["valor"].to_numpy(float)
        if len(pts) > DIRECT:
            w = multiquadric_weights(pts / scale, v)
        else:
            d = np.hypot(*(pts[:, None, :] - pts[None, :, :]).transpose(2, 0, 1))
            w = np.linalg.solve(np.sqrt((d / scale) ** 2 + 1.0), v)
        return pdf[[*group, "x", "y"]].assign(w=w, scale=scale)

    return _fit_each(stations, group, fit, _fit_schema(stations, group))


def _axis_kernel(x: np.ndarray, length: float) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The Gaussian kernel along one axis as a sum of products of functions: their strengths, largest first, and their values at points."""
    low, side = float(x.min()), float(np.ptp(x))
    if side == 0:
        return np.ones(1), lambda at: np.ones((len(at), 1))
    at, weight = np.polynomial.legendre.leggauss(int(6 * side / length) + 40)
    at, root = low + (at + 1) * side / 2, np.sqrt(weight / 2)
    kernel = lambda a, b: np.exp(-(np.subtract.outer(a, b) ** 2) / (2 * length * length))
    strength, vectors = np.linalg.eigh(root[:, None] * kernel(at, at) * root)
    strength, vectors = strength[::-1], vectors[:, ::-1]
    sound = strength > 1e-15 * strength[0]
    strength, vectors = strength[sound], vectors[:, sound]
    turn = root[:, None] * vectors / np.sqrt(strength)
    return strength, lambda points: kernel(points, at) @ turn


def _cholesky_ends(a: np.ndarray) -> np.ndarray:
    """Diagonal of the Cholesky factor; ``a`` is used up, block by block, so that no second matrix is needed."""
    n, step = len(a), 256
    diagonal = np.empty(n)
    for i in range(0, n, step):
        j = min(i + step, n)
        corner = np.linalg.cholesky(a[i:j, i:j])
        diagonal[i:j] = corner.diagonal()
        panel = np.linalg.solve(corner, a[j:, i:j].T).T
        for k in range(j, n, 1024):
            top = min(k + 1024, n)
            a[k:, k:top] -= panel[k - j :] @ panel[k - j : top - j].T
    return diagonal


def gaussian_weights(pts: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and length of the hyperparameters with the best marginal likelihood, without a matrix of all nodes.

    A Gaussian kernel is the product of its axes, and along an axis a sum of a few products of functions: as many as the extent holds lengths, whatever
    the number of nodes. In these coordinates all systems are of that size; directions far below the least noise are left out.
    """
    n = len(pts)
    extent = float(np.hypot(*np.ptp(pts, axis=0))) or 1.0
    least = NEGLIGIBLE * min(NOISE_LEVELS) / max(SIGNAL_LEVELS)
    ratios = sorted({signal / noise for signal in SIGNAL_LEVELS for noise in NOISE_LEVELS})

    def coordinates(length: float):
        (sx, fx), (sy, fy) = _axis_kernel(pts[:, 0], length), _axis_kernel(pts[:, 1], length)
        ix, iy = np.nonzero(np.multiply.outer(sx, sy) * n > least)
        return len(ix), lambda some: fx(pts[some, 0])[:, ix] * fy(pts[some, 1])[:, iy]

    def system(length: float) -> tuple[np.ndarray, np.ndarray]:
        m, values = coordinates(length)
        gram, right = np.zeros((m, m)), np.zeros(m)
        for some in _stretches(n, m, WIDE):
            part = values(some)
            right += part.T @ v[some]
            for i in range(0, m, 1024):  # the lower half
                gram[i:, i : i + 1024] += part[:, i:].T @ part[:, i : i + 1024]
        return gram, right

    best = None
    for share in LENGTH_SHARES:
        gram, right = system(share * extent)
        m = len(gram)
        scores = {}
        for ratio in ratios:
            # the last pivot of the bordered matrix is what the fit leaves of the values
            whole = np.empty((m + 1, m + 1))
            np.multiply(gram, ratio, out=whole[:m, :m])
            whole[np.arange(m), np.arange(m)] += 1.0
            whole[m, :m] = whole[:m, m] = np.sqrt(ratio) * right
            whole[m, m] = v @ v
            ends = _cholesky_ends(whole)
            scores[ratio] = (float(ends[-1] ** 2), 2 * float(np.log(ends[:-1]).sum()))
            del whole
        del gram
        for signal in SIGNAL_LEVELS:
            for noise in NOISE_LEVELS:
                left, volume = scores[signal / noise]
                score = -0.5 * left / noise - 0.5 * (volume + n * np.log(noise))
                if best is None or score > best[0]:
                    best = (score, share * extent, signal / noise)
    _, length, ratio = best
    gram, right = system(length)
    m = len(gram)
    for i in range(0, m, 1024):
        gram[i : i + 1024, i:] = gram[i:, i : i + 1024].T
    gram *= ratio
    gram[np.arange(m), np.arange(m)] += 1.0
    found = ratio * np.linalg.solve(gram, right)
    del gram
    values = coordinates(length)[1]
    fitted = np.concatenate([values(some) @ found for some in _stretches(n, m, WIDE)])
    return ratio * (v - fitted), length


def kriging_fit(stations: DataFrame, group: list[str]) -> DataFrame:
    """Gaussian-process weights; hyperparameters with the best marginal likelihood on a fixed list."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pts, v = pdf[["x", "y"]].to_numpy(float), pdf["valor"].to_numpy(float)
        if len(pts) > DIRECT:
            w, length = gaussian_weights(pts, v)
            return pdf[[*group, "x", "y"]].assign(w=w, scale=length)
        d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2)
        extent = float(np.hypot(*(pts.max(axis=0) - pts.min(axis=0)))) or 1.0
        best = None
        for share in LENGTH_SHARES:
            shape = np.exp(-d2 / (2 * (share * extent) ** 2))
            values, vectors = np.linalg.eigh(shape)
            rotated = vectors.T @ v
            for signal in SIGNAL_LEVELS:
                for noise in NOISE_LEVELS:
                    spectrum = signal * np.maximum(values, 0) + noise
                    score = -0.5 * (rotated**2 / spectrum).sum() - 0.5 * np.log(spectrum).sum()
                    if best is None or score > best[0]:
                        best = (score, share * extent, signal * (vectors @ (rotated / spectrum)))
        return pdf[[*group, "x", "y"]].assign(w=best[2], scale=best[1])

    return _fit_each(stations, group, fit, _fit_schema(stations, group))


def evaluate(cells: DataFrame, fitted: DataFrame, group: list[str], kind: str, chunk: int = 1024) -> DataFrame:
    """Σ w·basis(distance) per cell and group, or the value of the nearest node. Nodes are packed in arrays of bounded size, copied per salt."""
    number = F.pmod(F.xxhash64("x", "y"), F.greatest(F.lit(1), F.ceil(F.col("_n") / chunk)).cast("int"))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = (
        fitted.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))  # not a join: the fit runs once
        .groupBy(*group, number.alias("_ch"))
        .agg(F.collect_list(F.struct("x", "y", "w")).alias("_nodes"), F.first("scale").alias("_scale"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        .repartition(tasks, *group, "_ch", "_salt")  # few rows, each of much work
    )
    spread = cells.select("cell", F.col("x").alias("_x"), F.col("y").alias("_y")).withColumn(
        "_salt", F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int")
    )

    def basis(s: Column) -> Column:
        dx, dy = s["x"] - F.col("_x"), s["y"] - F.col("_y")
        d2 = dx * dx + dy * dy
        if kind == "rbf":
            return F.sqrt(d2 / (F.col("_scale") * F.col("_scale")) + 1.0)
        return F.exp(-d2 / (2 * F.col("_scale") * F.col("_scale")))

    if kind == "nearest":

        def scored(s: Column) -> Column:
            dx, dy = s["x"] - F.col("_x"), s["y"] - F.col("_y")
            return F.struct((dx * dx + dy * dy).alias("d2"), s["w"].alias("w"))

        close = spread.join(packed, "_salt").select(*group, "cell", F.array_min(F.transform("_nodes", scored)).alias("_v"))
        return close.groupBy(*group, "cell").agg(F.min("_v").alias("_v")).select(*group, "cell", F.col("_v.w").alias("valor"))
    partial = spread.join(packed, "_salt").select(
        *group, "cell", F.aggregate("_nodes", F.lit(0.0), lambda acc, s: acc + s["w"] * basis(s)).alias("_v")
    )
    return partial.groupBy(*group, "cell").agg(F.sum("_v").alias("valor"))


def triangulate(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles by incremental insertion into a large enclosing triangle."""
    centre = (points.max(axis=0) + points.min(axis=0)) / 2
    span = float((points.max(axis=0) - points.min(axis=0)).max()) or 1.0
    corners = centre + span * np.array([[-1e4, -1e4], [1e4, -1e4], [0.0, 1e4]])
    pts = np.vstack([points, corners])
    corner = pts.tolist()
    n = len(points)
    # places of gone triangles are taken again; the circle of an empty place holds nothing
    triangles: list[tuple[int, int, int] | None] = [(n, n + 1, n + 2)]
    circles = np.zeros((3, 2 * n + 64))
    circles[2] = -1.0
    circles[:, 0] = _circle(*pts[list(triangles[0])])
    free: list[int] = []
    for i, (x, y) in enumerate(points.tolist()):
        cx, cy, r2 = circles[:, : len(triangles)]
        bad = np.flatnonzero((cx - x) ** 2 + (cy - y) ** 2 < r2 * (1 - 1e-12)).tolist()
        border: dict[tuple[int, int], int] = {}
        for t in bad:
            a, b, d = triangles[t]
            for e in ((a, b), (b, d), (d, a)):
                key = e if e[0] < e[1] else (e[1], e[0])
                border[key] = border.get(key, 0) + 1
            triangles[t] = None
        circles[2, bad] = -1.0
        free += bad
        for (a, b), times in border.items():
            if times == 1:
                circle = _circle(corner[a], corner[b], corner[i])
                if circle is not None:
                    if not free:
                        free.append(len(triangles))
                        triangles.append(None)
                        if len(triangles) > circles.shape[1]:
                            circles = np.hstack([circles, np.full((3, len(triangles)), -1.0)])
                    t = free.pop()
                    triangles[t] = (a, b, i)
                    circles[:, t] = circle
    return [t for t in triangles if t is not None and max(t) < n]


def _circle(a, b, c):
    """Centre and squared radius, none for points on a line."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    if abs(d) < 1e-14:
        return None
    ux = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d
    uy = (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return (a[0] + ux, a[1] + uy, ux * ux + uy * uy)


def tin_fit(stations: DataFrame, group: list[str]) -> DataFrame:
    """Triangles with their corner values, one row each."""
    types = dict(stations.dtypes)
    schema = ", ".join([*(f"`{g}` {types[g]}" for g in group), *(f"{v}{i} double" for i in (1, 2, 3) for v in "xyv")])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pts, v = pdf[["x", "y"]].to_numpy(float), pdf["valor"].to_numpy(float)
        rows = []
        for t in triangulate(pts) if len(pts) >= 3 else []:
            rows.append([*pdf[group].iloc[0], *(u for i in t for u in (pts[i, 0], pts[i, 1], v[i]))])
        return pd.DataFrame(rows, columns=[*group, *(f"{u}{i}" for i in (1, 2, 3) for u in "xyv")])

    return _fit_each(stations, group, fit, schema)


def tin_surface(
    cells: DataFrame, stations: DataFrame, group: list[str], cell_size: float, extrapolate: bool = False
) -> DataFrame:
    """Linear value on the triangle that holds the cell; null outside, or the nearest station's value."""
    triangles = R.with_bounds(
        cut_lineage(tin_fit(stations, group)).withColumn("ring", F.array(*[R.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3)]))
    )
    hits = join_points_polygons(cells.select("cell", F.col("x").alias("px"), F.col("y").alias("py")), triangles, cell_size, x="px", y="py")
    x, y = F.col("px"), F.col("py")
    det = (F.col("y2") - F.col("y3")) * (F.col("x1") - F.col("x3")) + (F.col("x3") - F.col("x2")) * (F.col("y1") - F.col("y3"))
    a = ((F.col("y2") - F.col("y3")) * (x - F.col("x3")) + (F.col("x3") - F.col("x2")) * (y - F.col("y3"))) / det
    b = ((F.col("y3") - F.col("y1")) * (x - F.col("x3")) + (F.col("x1") - F.col("x3")) * (y - F.col("y3"))) / det
    value = a * F.col("v1") + b * F.col("v2") + (1 - a - b) * F.col("v3")
    # a cell on a shared side belongs to two triangles with the same value there
    inner = hits.groupBy(*group, "cell").agg(F.min(value).alias("valor"))
    if not extrapolate:
        return inner
    nodes = stations.select(*group, "x", "y", F.col("valor").alias("w"), F.lit(1.0).alias("scale"))
    return (
        evaluate(cells, nodes, group, "nearest")
        .withColumnRenamed("valor", "_near")
        .join(inner, [*group, "cell"], "left")
        .select(*group, "cell", F.coalesce("valor", "_near").alias("valor"))
    )
