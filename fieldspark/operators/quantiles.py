"""Exact interpolated quantiles of large columns, spread over tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with ``n`` and a column per requested probability.

    The built-in exact percentile keeps all distinct values of a group in one buffer. Here the quantiles of a whole column come from
    histograms, refined where the wanted ranks lie (``selected``); with groups, values are counted, split by range and ranked
    inside each range, so one huge group spreads over all tasks.
    """
    if not group:
        n, found = selected(df, value, list(probs.values()))
        row = [n, *[found.get(p) for p in probs.values()]]
        schema = ", ".join(["n long", *(f"`{name}` double" for name in probs)])
        return df.sparkSession.createDataFrame([row] if n else [], schema)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = group
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = cut_lineage(
        counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id())
    )
    per_part = placed.groupBy("_part", *keys).agg(F.sum("_n").alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "_part",
        *keys,
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_s").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = Window.partitionBy("_part", *keys).orderBy(value)
    ranked = placed.withColumn("_cum", F.sum("_n").over(inside)).join(offsets, ["_part", *keys])
    hi = F.col("_before") + F.col("_cum")
    lo = hi - F.col("_n")
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((lo <= low) & (low < hi), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when((lo <= high) & (high < hi), F.col(value))).alias(f"_{name}_hi"),
        ]
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    out = [
        (
            F.col(f"_{name}_lo")
            + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * (F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1)))
        ).alias(name)
        for name, p in probs.items()
    ]
    return picked.select(*group, "n", *out)


def selected(df: DataFrame, value: str, probs: list[float], bins: int = 1024) -> tuple[int, dict[float, float]]:
    """(number of values, interpolated quantile by probability) of one column.

    A pass counts the values of each interval that holds a wanted rank in ``bins`` parts, with their least and greatest value; the part with
    the rank is the next interval. It ends when these are single values, after three or four passes as a rule. A pass reads one column,
    adds up in the tasks and sends at most 2 x probabilities x bins rows; nothing is stored, however many distinct values there are.
    """
    v = F.col(value).cast("double")
    base = df.select(v.alias("v")).filter("v IS NOT NULL")
    n, least, most = base.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return 0, {}
    ranks = {k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
    places = {k: (least, most, 0) for k in ranks}  # the value of a rank lies between the first two; so many values are smaller
    while wide := sorted({(lo, hi, before) for lo, hi, before in places.values() if lo < hi}):
        at = None
        for i, (lo, hi, _) in enumerate(wide):
            part = F.least(F.floor((F.col("v") - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
            inside, here = F.col("v").between(lo, hi), F.struct(F.lit(i).alias("i"), part.alias("part"))
            at = F.when(inside, here) if at is None else at.when(inside, here)
        counts = base.withColumn("at", at).filter("at IS NOT NULL").groupBy("at").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        by: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["at"]["i"], r["at"]["part"])):
            by.setdefault(r["at"]["i"], []).append(r)
        for k, (lo, hi, before) in places.items():
            if lo < hi:
                for r in by[wide.index((lo, hi, before))]:
                    if k < before + r["c"]:
                        places[k] = (r["lo"], r["hi"], before)
                        break
                    before += r["c"]
    out = {}
    for p in probs:
        low, high = (places[f(p * (n - 1))][0] for f in (math.floor, math.ceil))
        out[p] = low + (high - low) * (p * (n - 1) - math.floor(p * (n - 1)))
    return n, out
