"""Zonal statistics over a pyramid of pixel blocks.

Pixels are squares of a grid. Their statistics are kept per block of 64 x 64 pixels, per quarter of a block, and per square of 8 x 8, which also
holds its pixels. A zone takes whole blocks, quarters and squares that lie inside it from their sums, and tests single pixels only in squares that
its border may cross. Its ring rides once per block, and once per such quarter and square, not once per pixel; the pixel source is
read once, for both pixel rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.session import cut_lineage, spread

#: Pixels along a block of each level, each a multiple of the next.
SIDES = (64, 32, 8)
#: Statistics of a set of pixels: by the centre rule all valid values count, by the touch rule those in [-1, 1].
SUMS = ("n", "s", "s2", "tn", "ts")
LEAST, MOST = ("lo", "tlo"), ("hi", "thi")
STATS = [*SUMS, *LEAST, *MOST]


def _totals() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], *[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in MOST]]


@dataclass
class Pyramid:
    size: float  # side of a pixel
    sides: tuple[int, ...]
    sums: DataFrame  # level, bx, by, statistics
    pixels: DataFrame  # bx, by (of the last level), pixels: array of (px, py, statistics)


def pixel_pyramid(pixels: DataFrame, size: float, value: str = "ndvi", sides: tuple[int, ...] = SIDES) -> Pyramid:
    """``pixels`` has centre coordinates ``x, y``; several rows of one pixel are added up, rows without a value left out."""
    v = F.col(value).cast("double")
    touched = F.when((v >= -1) & (v <= 1), v)
    index = lambda c: F.floor(F.col(c) / size).cast("long")
    per_pixel = pixels.where(F.col(value).isNotNull()).groupBy(index("x").alias("px"), index("y").alias("py")).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.count(touched).alias("tn"), F.sum(touched).alias("ts"),
        F.min(v).alias("lo"), F.min(touched).alias("tlo"), F.max(v).alias("hi"), F.max(touched).alias("thi"),
    )
    up = lambda c, by, name: F.floor(F.col(c) / by).cast("long").alias(name)
    # at most side x side pixels
    squares = cut_lineage(
        per_pixel.groupBy(up("px", sides[-1], "bx"), up("py", sides[-1], "by")).agg(F.collect_list(F.struct("px", "py", *STATS)).alias("pixels"), *_totals())
    )
    last = len(sides) - 1
    now = squares.select(F.lit(last).alias("level"), "bx", "by", *STATS)
    sums = now
    for level in range(last - 1, -1, -1):
        by = sides[level] // sides[level + 1]
        now = now.groupBy(up("bx", by, "bx"), up("by", by, "by")).agg(*_totals()).select(F.lit(level).alias("level"), "bx", "by", *STATS)
        sums = sums.union(now)
    return Pyramid(size, sides, sums, squares.select("bx", "by", "pixels"))


def _square(bx: Column, by: Column, side: float) -> list[Column]:
    return [bx * side, by * side, (bx + 1) * side, (by + 1) * side]


def _place(side: float) -> Column:
    """``in``, ``out`` or ``border`` for a square and the edges of a zone, border if any edge meets the closed square."""
    x0, y0, x1, y1 = _square(F.col("bx"), F.col("by"), side)
    return (
        F.when(R.edges_meet_square(F.col("es"), x0, y0, x1, y1, 1e-9), "border")
        .when(R.edges_hold(F.col("es"), (x0 + x1) / 2, (y0 + y1) / 2), "in").otherwise("out")
    )


def zone_totals(pyramid: Pyramid, zones: DataFrame, key: str, touch: bool = True) -> DataFrame:
    """Per zone with any pixel: the statistics by the centre rule and, with ``touch``, by the touch rule. ``zones``: key, ``ring`` or ``parts`` (several parts, with
    holes), and the box.

    A pixel counts by the centre rule if its centre lies in the zone (a centre on a shared border belongs to one neighbour), by the touch rule if
    its closed square shares any point with it.
    """
    size, sides = pyramid.size, pyramid.sides
    box = zones.select(key, R.shape_edges(zones).alias("es"), "minx", "miny", "maxx", "maxy")

    def span(lo: str, hi: str, side: float) -> Column:
        # closed squares: a border that lies on a grid line touches both sides
        return F.sequence((F.ceil(F.col(lo) / side) - 1).cast("long"), F.floor(F.col(hi) / side).cast("long"))

    def reached(side: float) -> Column:
        x0, y0, x1, y1 = _square(F.col("bx"), F.col("by"), side)
        return (x0 <= F.col("maxx")) & (x1 >= F.col("minx")) & (y0 <= F.col("maxy")) & (y1 >= F.col("miny"))

    top, last = sides[0] * size, len(sides) - 1
    met = box.withColumn("bx", F.explode(span("minx", "maxx", top))).withColumn("by", F.explode(span("miny", "maxy", top)))
    # blocks without pixels add nothing; the others are dealt out, as the tests of all levels follow in one go
    held = pyramid.sums.where("level = 0").select("bx", "by")
    met = spread(met.join(held, ["bx", "by"], "left_semi")).withColumns({"level": F.lit(0), "place": _place(top)}).where("place <> 'out'")
    for level in range(1, last + 1):
        by = sides[level - 1] // sides[level]
        down = lambda c, by=by: F.sequence(F.col(c) * by, F.col(c) * by + by - 1)
        open_ = F.col("place") == "border"
        at = F.flatten(F.transform(down("bx"), lambda u: F.transform(down("by"), lambda v: F.struct(u.alias("bx"), v.alias("by")))))
        met = met.withColumn("_at", F.explode(F.when(open_, at).otherwise(F.array(F.struct("bx", "by")))))
        met = met.withColumns({"bx": F.col("_at.bx"), "by": F.col("_at.by")}).drop("_at").where(~open_ | reached(sides[level] * size))
        now = {"level": F.when(open_, F.lit(level)).otherwise(F.col("level")), "place": F.when(open_, _place(sides[level] * size)).otherwise(F.col("place"))}
        met = met.withColumns(now).where("place <> 'out'")
    # edges beside the rows of a square say nothing about its pixels
    y0, y1 = F.col("by") * (sides[last] * size), (F.col("by") + 1) * (sides[last] * size)
    beside = lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= y1) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= y0)
    met = met.withColumn("es", F.when(F.col("place") == "border", F.filter("es", beside)))

    x0, y0 = lambda p: p["px"] * size, lambda p: p["py"] * size
    pixels = pyramid.pixels.select(F.lit(last).alias("level"), "bx", "by", "pixels")
    blocks = pyramid.sums.join(pixels, ["level", "bx", "by"], "left")

    def near(p: Column) -> Column:
        return (x0(p) <= F.col("maxx")) & (x0(p) + size >= F.col("minx")) & (y0(p) <= F.col("maxy")) & (y0(p) + size >= F.col("miny"))

    def judged(p: Column) -> Column:
        centre = R.edges_hold(F.col("es"), x0(p) + size / 2, y0(p) + size / 2, "half_open")
        meets = centre | R.edges_meet_square(F.col("es"), x0(p), y0(p), x0(p) + size, y0(p) + size) if touch else F.lit(False)
        return F.struct(p.alias("p"), centre.alias("c"), meets.alias("t"))

    whole = F.array(F.struct(F.struct(F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"), *STATS).alias("p"), F.lit(True).alias("c"), F.lit(True).alias("t")))
    single = F.filter(F.transform(F.filter("pixels", near), judged), lambda q: q["c"] | q["t"])
    found = met.join(blocks, ["level", "bx", "by"]).select(key, F.explode(F.when(F.col("place") == "in", whole).otherwise(single)).alias("q"))
    takes = lambda c: F.col("q.t" if c.startswith("t") else "q.c")
    return found.select(key, *[F.when(takes(c), F.col("q.p")[c]).alias(c) for c in STATS]).groupBy(key).agg(*_totals())


def centre_stats(totals: DataFrame, key: str) -> DataFrame:
    """Mean, min, max, population deviation and number by the centre rule, for zones that have any."""
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    return totals.where("n > 0").select(key, mean.alias("mean"), F.col("lo").alias("min"), F.col("hi").alias("max"), spread.alias("std"), "n")


def touch_stats(totals: DataFrame, key: str) -> DataFrame:
    return totals.where("tn > 0").select(key, F.col("thi").alias("max"), F.col("tlo").alias("min"), (F.col("ts") / F.col("tn")).alias("mean"), F.col("tn").alias("n"))


def mean_or_touched(totals: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """Centre rule first, all touched pixels where that finds none, else null; with the outcome of each zone."""
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    touched = F.when(F.col("tn") > 0, F.col("ts") / F.col("tn"))
    outcome = F.when(mean.isNotNull(), "validos").when(touched.isNotNull(), "pequenos").otherwise("vacios")
    return zones.select(key).join(totals, key, "left").select(key, F.coalesce(mean, touched).alias("ndvi"), outcome.alias("outcome"))
