"""Rasters as pixel tables ``(scene, tile, r, c, bands…)``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.functions import spectral as S
from fieldspark.operators.quantiles import exact_quantiles
from fieldspark.operators.spatial import join_points_polygons
from fieldspark.session import cut_lineage

PIXEL = ["tile", "r", "c"]


# --- scene selection -------------------------------------------------------------------------------------------------


def search_scenes(scenes: DataFrame, target: Column, max_cloud: float) -> DataFrame:
    """All scenes of the date nearest to the target among those clear enough; the earlier date on ties."""
    clear = scenes.filter(F.col("cloud") <= max_cloud)
    best = clear.agg(
        F.min_by("fecha", F.struct(F.abs(F.datediff("fecha", target)), F.col("fecha"))).alias("fecha")
    )
    return clear.join(F.broadcast(best), "fecha", "left_semi")  # one row


def best_scene(scenes: DataFrame, target: Column, max_cloud: float) -> DataFrame:
    """The clearest scene; ties by time distance, then id."""
    clear = scenes.filter(F.col("cloud") <= max_cloud)
    return clear.orderBy("cloud", F.abs(F.datediff("fecha", target)), "scene").limit(1)


def recent_scene_dates(scenes: DataFrame, max_cloud: float, n: int) -> DataFrame:
    """Scenes of the newest ``n`` dates that have any clear scene."""
    clear = scenes.filter(F.col("cloud") <= max_cloud)
    newest = clear.select("fecha").distinct().orderBy(F.desc("fecha")).limit(n)
    return clear.join(newest, "fecha", "left_semi")


def pick_scenes_per_tile(scenes: DataFrame, max_cloud: float, per_tile: int, total: int) -> DataFrame:
    """Best ``per_tile`` scenes of every tile, then tiles in order up to ``total``."""
    best = Window.partitionBy("tile").orderBy("cloud", F.desc("fecha"), "scene")
    picked = (
        scenes.filter(F.col("cloud") <= max_cloud)
        .withColumn("pos", F.row_number().over(best))
        .filter(F.col("pos") <= per_tile)
    )
    return picked.orderBy("tile", "pos").limit(total)


# --- per pixel -------------------------------------------------------------------------------------------------------


def with_ndvi(pixels: DataFrame, masked: Column | None = None) -> DataFrame:
    """Adds ``ndvi``: clean reflectances, null where the pixel is masked."""
    bad = S.invalid_class(F.col("scl")) if masked is None else masked
    red, nir = S.reflectance(F.col("red")), S.reflectance(F.col("nir"))
    return pixels.withColumn("ndvi", F.when(~bad, S.ndvi(red, nir)))


def cloud_buffer(
    pixels: DataFrame, invalid: Column, reach: int, keys: list[str], dense: bool = False
) -> DataFrame:
    """Adds ``masked``: an invalid pixel lies within ``reach`` rows and columns (8-neighbour dilation).

    Dense grids take two window passes, along the row and along the column. On sparse grids the pixel between two passes
    may be absent, so the first pass writes its marks as rows of their own.
    """
    flagged = pixels.withColumn("_bad", invalid.cast("int"))
    along_r = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-reach, reach)
    if dense:
        along_c = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-reach, reach)
        first = flagged.withColumn("_bad", F.max("_bad").over(along_c))
        return first.withColumn("masked", F.max("_bad").over(along_r) == 1).drop("_bad")
    # a row is broken into runs, so that each run of invalid pixels marks its columns once
    by_col = Window.partitionBy(*keys, "r").orderBy("c")
    bad = flagged.filter("_bad = 1").select(*keys, "r", "c")
    runs = (
        bad.withColumn("_new", (F.col("c") - F.lag("c").over(by_col) > 2 * reach + 1).cast("int"))
        .withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(by_col))
        .groupBy(*keys, "r", "_run")
        .agg(F.collect_list("c").alias("_cs"))
    )
    spread = F.array_distinct(
        F.flatten(F.transform("_cs", lambda v: F.sequence(v - F.lit(reach), v + F.lit(reach))))
    )
    marks = runs.select(*keys, "r", F.explode(spread).alias("c")).withColumn("_bad", F.lit(1))
    both = flagged.withColumn("_row", F.lit(True)).unionByName(
        marks.withColumn("_row", F.lit(False)), allowMissingColumns=True
    )
    return (
        both.withColumn("masked", F.max("_bad").over(along_r) == 1).filter("_row").drop("_bad", "_row")
    )


# --- composites ------------------------------------------------------------------------------------------------------


def accepted_scenes(pixels: DataFrame, min_share: float, keys: list[str] | None = None) -> DataFrame:
    """Scenes whose share of valid pixels is high enough; partial counts are made before the shuffle."""
    keys = keys or ["scene"]
    share = F.count("ndvi") / F.count(F.lit(1))
    return pixels.groupBy(*keys).agg(share.alias("_share")).filter(F.col("_share") >= min_share).select(*keys)


def weighted_composite(
    pixels: DataFrame,
    table: tuple[dict[int, float], float] = S.MOSAIC_WEIGHTS,
    min_share: float = 0.05,
    keys: list[str] | None = None,
) -> DataFrame:
    """Σw·v/Σw per pixel over accepted scenes, with the number of valid observations."""
    valid = pixels.filter("ndvi IS NOT NULL").withColumn("_w", S.quality_weight(F.col("scl"), table))
    if min_share > 0:
        valid = valid.join(accepted_scenes(pixels, min_share), "scene", "left_semi")
    sums = valid.groupBy(*(keys or PIXEL)).agg(
        F.sum(F.col("_w") * F.col("ndvi")).alias("_top"), F.sum("_w").alias("_bottom"), F.count(F.lit(1)).alias("n_obs")
    )
    return sums.select(
        *(keys or PIXEL), F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).alias("ndvi"), "n_obs"
    )


def merge_day_best(pixels: DataFrame, table=S.BEST_PIXEL_WEIGHTS) -> DataFrame:
    """Per day and pixel the highest quality; the first scene on ties."""
    valid = pixels.filter("ndvi IS NOT NULL").withColumn("quality", S.quality_weight(F.col("scl"), table))
    order = F.struct(-F.col("quality"), F.col("scene"))
    return valid.groupBy("fecha", *PIXEL).agg(
        F.min_by("ndvi", order).alias("ndvi"),
        F.max("quality").alias("quality"),
        F.min_by("scene", order).alias("scene"),
    )


def composite_best_pixel(days: DataFrame) -> DataFrame:
    """Best score over days: quality × (1 − 0.3·i/n), i = 0 for the newest day; the newer day on ties, score > 0."""
    dates = days.select("fecha").distinct()
    order = Window.orderBy(F.desc("fecha"))
    # one row per acquisition date
    ranks = dates.select(
        "fecha",
        (F.row_number().over(order) - 1).alias("i"),
        F.count(F.lit(1)).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    scored = days.join(ranks, "fecha").withColumn(
        "score", F.col("quality") * (1.0 - F.col("i") / F.col("n") * 0.3)
    )
    best = F.struct(F.col("score"), -F.col("i"))
    return (
        scored.filter("score > 0")
        .groupBy(*PIXEL)
        .agg(F.max_by("ndvi", best).alias("ndvi"), F.max("score").alias("score"), F.max_by("fecha", best).alias("fecha"))
    )


def composite_max_median(pixels: DataFrame, min_share: float = 0.02) -> DataFrame:
    valid = pixels.filter("ndvi IS NOT NULL").join(accepted_scenes(pixels, min_share), "scene", "left_semi")
    # the group is one pixel over its scenes, so the exact percentile stays small
    return valid.groupBy(*PIXEL).agg(
        F.max("ndvi").alias("ndvi_max"), F.percentile("ndvi", F.lit(0.5)).alias("ndvi_median")
    )


# --- statistics ------------------------------------------------------------------------------------------------------


def global_stats(raster: DataFrame, value: str = "ndvi", group: list[str] | None = None) -> DataFrame:
    """min, max, mean, median, population deviation, valid count and coverage in percent."""
    group = group or []
    basic = raster.groupBy(*group).agg(
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.count(value).alias("n_valid"),
        (100.0 * F.count(value) / F.count(F.lit(1))).alias("coverage"),
    )
    middle = exact_quantiles(raster, group, value, {"median": 0.5}).drop("n")
    if group:
        return basic.join(middle, group, "left")
    return basic.withColumn("_k", F.lit(1)).join(middle.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")


def histogram(raster: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per bin; the upper limit belongs to the last bin, values outside are left out."""
    v = F.col(value)
    number = F.when(v == high, F.lit(bins - 1)).otherwise(F.floor((v - low) / (high - low) * bins).cast("int"))
    return raster.filter((v >= low) & (v <= high)).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stretch(raster: DataFrame, value: str = "ndvi", low: float = 0.02, high: float = 0.98) -> DataFrame:
    limits = exact_quantiles(raster, [], value, {"_lo": low, "_hi": high}).drop("n")  # one row
    v = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col(value)))
    return (
        raster.withColumn("_k", F.lit(1))
        .join(F.broadcast(limits.withColumn("_k", F.lit(1))), "_k")
        .withColumn("stretched", F.when(F.col("_hi") > F.col("_lo"), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
        .drop("_k", "_lo", "_hi")
    )


def scale_to_byte(raster: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Min–max scaling to 0..255 per group."""
    limits = raster.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 255))
    return raster.join(limits, group).withColumn("byte", scaled.cast("int")).drop("_lo", "_hi")


# --- zones -----------------------------------------------------------------------------------------------------------


def zonal_stats(pixels: DataFrame, zones: DataFrame, key: str, cell: float, value: str = "ndvi") -> DataFrame:
    """Mean, min, max and population deviation of the valid pixels whose centre lies in the zone.

    ``pixels`` has centre coordinates ``x, y``; ``zones`` has ``ring`` and its box. Partial sums are built before the
    shuffle, so a zone with very many pixels does not gather in one task.
    """
    hits = join_points_polygons(
        pixels.filter(F.col(value).isNotNull()).select("x", "y", value),
        zones.select(key, "ring", "minx", "miny", "maxx", "maxy"),
        cell,
        boundary="half_open",
    )
    return hits.groupBy(key).agg(
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
        F.count(F.lit(1)).alias("n"),
    )


def zonal_all_touched(pixels: DataFrame, zones: DataFrame, key: str, size: float, value: str = "ndvi") -> DataFrame:
    """Max, min and mean of the pixels in [−1, 1] that share any point with the zone.

    Pixels are squares of side ``size`` around ``x, y``. Zones are listed by the grid cells of that same grid that their
    box covers, so the join is on the exact pixel and no pixel row is copied.
    """
    half = size / 2.0
    v = F.col(value)
    near = pixels.filter((v >= -1) & (v <= 1)).withColumns(
        {
            "_px": F.floor(F.col("x") / size).cast("long"),
            "_py": F.floor(F.col("y") / size).cast("long"),
        }
    )
    box = zones.select(key, "ring", "minx", "miny", "maxx", "maxy")
    covered = box.withColumn(
        "_px",
        F.explode(F.sequence(_touch_low("minx", size), _touch_high("maxx", size))),
    ).withColumn("_py", F.explode(F.sequence(_touch_low("miny", size), _touch_high("maxy", size))))
    square = R.rectangle(F.col("x") - half, F.col("y") - half, F.col("x") + half, F.col("y") + half)
    hits = near.select("_px", "_py", "x", "y", value).join(covered, ["_px", "_py"]).filter(
        R.polygons_intersect(F.col("ring"), square)
    )
    return hits.groupBy(key).agg(
        F.max(value).alias("max"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def _touch_low(col: str, size: float) -> Column:
    """First grid cell whose closed square can reach a coordinate: a border belongs to both sides."""
    return (F.ceil(F.col(col) / size) - 1).cast("long")


def _touch_high(col: str, size: float) -> Column:
    return F.floor(F.col(col) / size).cast("long")


def zonal_mean_fallback(pixels: DataFrame, zones: DataFrame, key: str, size: float, cell: float) -> DataFrame:
    """Centre rule first, all touched pixels where that finds none, else null; with the outcome of each zone.

    The second pass runs only on zones left empty by the first.
    """
    centre = zonal_stats(pixels, zones, key, cell).select(key, F.col("mean").alias("_a"))
    left = zones.join(centre, key, "left_anti")
    touched = zonal_all_touched(pixels, left, key, size).select(key, F.col("mean").alias("_b"))
    outcome = (
        F.when(F.col("_a").isNotNull(), "validos").when(F.col("_b").isNotNull(), "pequenos").otherwise("vacios")
    )
    return (
        zones.select(key)
        .join(centre, key, "left")
        .join(touched, key, "left")
        .select(key, F.coalesce("_a", "_b").alias("ndvi"), outcome.alias("outcome"))
    )


def sample_at(points: DataFrame, raster: DataFrame, size: float, key: str, value: str = "ndvi") -> DataFrame:
    """Value of the pixel under each point: an equi-join on the pixel row and column.

    ``raster`` has ``gx, gy``, the pixel index counted from the origin.
    """
    placed = points.select(key, "x", "y").withColumns(
        {"gx": F.floor(F.col("x") / size).cast("long"), "gy": F.floor(F.col("y") / size).cast("long")}
    )
    return placed.join(raster.select("gx", "gy", value), ["gx", "gy"], "left").select(key, value)


# --- gaps and resampling ---------------------------------------------------------------------------------------------


def fill_gaps(raster: DataFrame, max_gap: int = 50, block: int = 256, keys: list[str] | None = None) -> DataFrame:
    """Fills 4-connected groups of null pixels of at most ``max_gap`` pixels; larger groups stay null.

    A pixel of such a group sees the whole group within ``max_gap`` rows and columns. Blocks with that margin are
    therefore independent: no labels travel between them and the block size bounds the group. A null pixel gets the mean
    of the linear interpolations along its row and along its column between the valid pixels that border the gap, else
    the nearest valid pixel that touches the gap. ``large`` marks null pixels of larger groups.
    """
    keys = keys or ["tile"]
    halo = max_gap + 2
    schema = ", ".join([*(f"{k} {dict(raster.dtypes)[k]}" for k in keys), "r int, c int, ndvi double, filled boolean, large boolean"])
    r, c = F.col("r").cast("int"), F.col("c").cast("int")

    def homes(v: Column) -> Column:
        return F.sequence(F.floor((v - halo) / block).cast("int"), F.floor((v + halo) / block).cast("int"))

    spread = (
        raster.select(*keys, r.alias("r"), c.alias("c"), F.col("ndvi").cast("double").alias("ndvi"))
        .withColumn("_br", F.explode(homes(F.col("r"))))
        .withColumn("_bc", F.explode(homes(F.col("c"))))
    )

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        br, bc = key[-2], key[-1]
        r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
        rows, cols = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        grid = np.full((rows.max() + 1, cols.max() + 1), np.nan)
        known = np.zeros(grid.shape, bool)
        grid[rows, cols] = pdf["ndvi"].to_numpy(float)
        known[rows, cols] = True
        values, large = _fill_block(grid, known, max_gap)
        pdf = pdf.assign(_v=values[rows, cols], _l=large[rows, cols])
        core = pdf[(pdf["r"] // block == br) & (pdf["c"] // block == bc)]
        out = core[[*keys, "r", "c"]].copy()
        out["ndvi"] = core["_v"].where(core["_v"].notna(), None)
        out["filled"] = core["ndvi"].isna() & core["_v"].notna()
        out["large"] = core["_l"]
        return out

    return spread.groupBy(*keys, "_br", "_bc").applyInPandas(fill, schema)


def label_gaps(empty: np.ndarray) -> np.ndarray:
    """Labels of 4-connected groups, 0 outside. Runs of a row are joined with those above that they touch; no pixel is walked alone."""
    height, width = empty.shape
    edge = np.diff(np.pad(empty, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, begin = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    if not len(row):
        return np.zeros(empty.shape, int)
    # runs are in the order of row and column, so those of the row above that overlap follow each other
    span = width + 1
    lo = np.searchsorted(row * span + end, (row - 1) * span + begin, "right")
    hi = np.maximum(lo, np.searchsorted(row * span + begin, (row - 1) * span + end, "left"))
    below = np.repeat(np.arange(len(row)), hi - lo)
    above = np.arange(len(below)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    group = np.arange(len(row))
    while True:
        least = np.minimum(group[below], group[above])
        new = group.copy()
        np.minimum.at(new, group[below], least)
        np.minimum.at(new, group[above], least)
        new = new[new]
        if (new == group).all():
            break
        group = new
    number = np.unique(group, return_inverse=True)[1].reshape(-1) + 1
    labels = np.zeros(empty.shape, int)
    labels[empty] = np.repeat(number, end - begin)
    return labels


def _fill_block(grid: np.ndarray, known: np.ndarray, max_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(values with small gaps filled, which pixels lie in large gaps)."""
    out = grid.copy()
    labels = label_gaps(np.isnan(grid) & known)
    sizes = np.bincount(labels.ravel())
    large = (sizes[labels] > max_gap) & (labels > 0)
    if not labels.any():
        return out, large
    order = np.argsort(labels.ravel(), kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for gap in range(1, len(sizes)):
        if sizes[gap] > max_gap:
            continue
        cells = np.stack(np.unravel_index(order[starts[gap] : starts[gap + 1]], grid.shape), axis=1)
        ring = _border_of(grid, cells)
        if len(ring) == 0:
            continue
        ring_values = grid[ring[:, 0], ring[:, 1]]
        for i, j in cells:
            guesses = [_between(grid[i, :], labels[i, :] == gap, j), _between(grid[:, j], labels[:, j] == gap, i)]
            guesses = [g for g in guesses if g is not None]
            if guesses:
                out[i, j] = sum(guesses) / len(guesses)
            else:
                d2 = (ring[:, 0] - i) ** 2 + (ring[:, 1] - j) ** 2
                out[i, j] = ring_values[int(np.argmin(d2))]
    return out, large


def _border_of(grid: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Valid pixels that touch the gap, at a side or a corner."""
    lo = np.maximum(cells.min(axis=0) - 1, 0)
    hi = np.minimum(cells.max(axis=0) + 1, np.array(grid.shape) - 1)
    near = np.zeros(tuple(hi - lo + 3), bool)
    for di in (0, 1, 2):
        for dj in (0, 1, 2):
            near[cells[:, 0] - lo[0] + di, cells[:, 1] - lo[1] + dj] = True
    valid = near[1:-1, 1:-1] & ~np.isnan(grid[lo[0] : hi[0] + 1, lo[1] : hi[1] + 1])
    return np.argwhere(valid) + lo


def _between(line: np.ndarray, gap: np.ndarray, at: int) -> float | None:
    """Linear value between the cells that border the gap on both sides; none when one of them is missing."""
    a = b = at
    while a >= 0 and gap[a]:
        a -= 1
    while b < len(line) and gap[b]:
        b += 1
    if a < 0 or b >= len(line) or np.isnan(line[a]) or np.isnan(line[b]):
        return None
    return float(line[a] + (line[b] - line[a]) * (at - a) / (b - a))


def fill_mean_smooth(raster: DataFrame, group: list[str], min_valid_pct: float = 5.0, sigma: float = 1.0) -> DataFrame:
    """Per raster: dropped below the valid share; nulls become the mean; Gaussian blur where any pixel was null.

    Needs full rectangles. Lines are gathered as arrays, one array per row and then per column of the raster.
    """
    raster = cut_lineage(raster)  # read three times below
    stats = raster.groupBy(*group).agg(
        F.avg("ndvi").alias("_mean"), (100.0 * F.count("ndvi") / F.count(F.lit(1))).alias("_pct"),
        (F.count("ndvi") < F.count(F.lit(1))).alias("_had_gaps"),
    )
    usable = raster.join(stats.filter(F.col("_pct") >= min_valid_pct), group).withColumn(
        "v", F.coalesce("ndvi", "_mean")
    )
    radius = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    kernel = [w / sum(weights) for w in weights]

    def blur_line(values: Column) -> Column:
        return R.let(values, blur_values)

    def blur_values(line: Column) -> Column:
        n = F.size(line)
        # mirror the borders: … b a | a b c … z | z y …
        def at(i: Column) -> Column:
            m = F.pmod(i, 2 * n)
            return F.when(m < n, m).otherwise(2 * n - 1 - m)

        def value(_, i: Column) -> Column:
            total = F.lit(0.0)
            for d, w in zip(range(-radius, radius + 1), kernel):
                total = total + F.get(line, at(i + d)) * F.lit(w)
            return total

        return F.transform(line, value)

    def blur(df: DataFrame, line_key: str, along: str) -> DataFrame:
        lines = df.groupBy(*group, line_key).agg(F.array_sort(F.collect_list(F.struct(along, "v"))).alias("_l"))
        smooth = lines.withColumn("_s", blur_line(F.transform("_l", lambda p: p["v"])))
        return smooth.select(*group, line_key, F.explode(F.arrays_zip("_l", "_s")).alias("_z")).select(
            *group, line_key, F.col(f"_z._l.{along}").alias(along), F.col("_z._s").alias("v")
        )

    whole = usable.filter("NOT _had_gaps").select(*group, "r", "c", "v")
    blurred = blur(blur(usable.filter("_had_gaps").select(*group, "r", "c", "v"), "r", "c"), "c", "r")
    return whole.unionByName(blurred.select(*group, "r", "c", "v"))


def regrid(
    source: DataFrame,
    targets: DataFrame,
    value: str,
    key: list[str],
    method: str = "bilinear",
) -> DataFrame:
    """Source values at fractional positions ``fr, fc`` of the targets (in source pixels, centres at whole numbers)."""
    if method == "nearest":
        placed = targets.withColumns(
            {"r": F.floor(F.col("fr") + 0.5).cast("long"), "c": F.floor(F.col("fc") + 0.5).cast("long")}
        )
        return placed.join(source.select("tile", "r", "c", value), ["tile", "r", "c"], "left").select(
            *key, value
        )
    r0, c0 = F.floor("fr"), F.floor("fc")
    dr, dc = F.col("fr") - r0, F.col("fc") - c0

    def corner(i: int, j: int) -> Column:
        w = (dr if i else 1 - dr) * (dc if j else 1 - dc)
        return F.struct((r0 + i).cast("long").alias("r"), (c0 + j).cast("long").alias("c"), w.alias("w"))

    corners = F.filter(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1)), lambda k: k["w"] > 0)
    spread = targets.withColumn("_k", F.explode(corners)).select(
        *key, F.col("_k.r").alias("r"), F.col("_k.c").alias("c"), F.col("_k.w").alias("_w"),
        *([] if "tile" in key else ["tile"]),
    )
    near = spread.join(source.filter(F.col(value).isNotNull()).select("tile", "r", "c", value), ["tile", "r", "c"])
    return near.groupBy(*key).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def target_grid(spark, minx: float, miny: float, maxx: float, maxy: float, res: float, max_dim: int | None = None) -> DataFrame:
    """One row per cell of a region; sides are rounded up and scaled down to ``max_dim``."""
    width, height = math.ceil((maxx - minx) / res), math.ceil((maxy - miny) / res)
    if max_dim is not None:
        scale = max(width / max_dim, height / max_dim, 1.0)
        width, height = math.ceil(width / scale), math.ceil(height / scale)
    step_x, step_y = (maxx - minx) / width, (maxy - miny) / height
    return spark.range(width * height).select(
        F.floor(F.col("id") / width).alias("r"),
        (F.col("id") % width).alias("c"),
        (F.lit(minx) + (F.col("id") % width + 0.5) * step_x).alias("x"),
        (F.lit(maxy) - (F.floor(F.col("id") / width) + 0.5) * step_y).alias("y"),
    )


def image_metadata(pixels: DataFrame, composite: DataFrame) -> DataFrame:
    """Run summary per tile: dates, scenes used, bounds, grid size and statistics, also as one JSON record."""
    inputs = pixels.groupBy("tile").agg(
        F.count_distinct("scene").alias("n_scenes"),
        F.min("fecha").alias("first_date"),
        F.max("fecha").alias("last_date"),
        F.min("c").alias("minx"),
        F.min("r").alias("miny"),
        (F.max("c") + 1).alias("maxx"),
        (F.max("r") + 1).alias("maxy"),
    )
    stats = composite.groupBy("tile").agg(
        F.min("ndvi").alias("ndvi_min"), F.max("ndvi").alias("ndvi_max"), F.avg("ndvi").alias("ndvi_mean"),
        F.count("ndvi").alias("n_valid"),
    )
    both = inputs.join(stats, "tile", "left").withColumns(
        {"width": F.col("maxx") - F.col("minx"), "height": F.col("maxy") - F.col("miny")}
    )
    return both.withColumn("record", F.to_json(F.struct(*[c for c in both.columns])))


def thumbnail_outcomes(
    zones: DataFrame, pixels: DataFrame, done: DataFrame, key: str, size: float, min_pct: float = 5.0, by: list[str] | None = None
) -> DataFrame:
    """Outcome per zone: skipped (already drawn), no_overlap, insufficient_data or success.

    ``by``: columns of the pixels, such as the scene, that outcomes are told apart by; null in the row of a zone without pixels.
    """
    by = by or []
    box = zones.join(done, key, "left_anti").withColumn(
        "_px", F.explode(F.sequence(F.floor(F.col("minx") / size).cast("long"), F.floor((F.col("maxx") - 1e-9) / size).cast("long")))
    ).withColumn(
        "_py", F.explode(F.sequence(F.floor(F.col("miny") / size).cast("long"), F.floor((F.col("maxy") - 1e-9) / size).cast("long")))
    ).select(key, "_px", "_py")
    placed = pixels.select(
        F.floor(F.col("x") / size).cast("long").alias("_px"), F.floor(F.col("y") / size).cast("long").alias("_py"), "ndvi", *by
    )
    counts = (
        box.join(placed, ["_px", "_py"])
        .groupBy(key, *by)
        .agg(F.count(F.lit(1)).alias("n"), F.count("ndvi").alias("n_valid"))
    )
    outcome = (
        F.when(F.col("_done").isNotNull(), "skipped")
        .when(F.col("n").isNull(), "no_overlap")
        .when(100.0 * F.col("n_valid") / F.col("n") < min_pct, "insufficient_data")
        .otherwise("success")
    )
    return (
        zones.select(key)
        .join(done.select(key).withColumn("_done", F.lit(1)), key, "left")
        .join(counts, key, "left")
        .select(key, *by, outcome.alias("outcome"))
    )
