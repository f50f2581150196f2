"""Neighbour search and interpolation from stations to plots and grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import ring as R
from fieldspark.functions.numbers import fixed
from fieldspark.session import cut_lineage

# Inverse-distance powers by variable (other variables: the default given by the caller).
IDW_POWERS = {
    "tempmax": 2.0,
    "tempmin": 2.0,
    "tempmedia": 2.0,
    "radiacion": 2.0,
    "humedadmedia": 2.5,
    "etpmon": 2.5,
    "velviento": 3.5,
    "precipitacion": 3.5,
    "pepmon": 3.5,
}

# Alert thresholds of the check against stations; 3.0 otherwise.
CHECK_THRESHOLDS = {"tempmax": 2.0, "tempmin": 2.0, "tempmedia": 1.5, "humedadmedia": 10.0, "etpmon": 0.4}
DEFAULT_THRESHOLD = 3.0

# Search radii in km and neighbour counts.
RADII_KM = (80.0, 110.0, 140.0, 170.0)
MIN_NEIGHBOURS = 4
MAX_NEIGHBOURS = 6

CHUNK = 1024  # stations held by one array
LISTED = 48  # values of one group in a cell of targets before it is halved
LEVELS = 10  # halvings of the largest radius
FINER = 12  # halvings of a neighbour search's cell where references are dense
SALTS = 16  # copies of each station array, or of a cell's row, so that one crowded cell spreads over tasks
TARGETS = 1024  # targets of one cell that are interpolated together
GROUPS = 64  # groups (dates, variables …) that are interpolated together
ELEMENTS = 1 << 22  # numbers of one working array


def _neighbour_offsets(reach: int) -> Column:
    return F.sequence(F.lit(-reach), F.lit(reach))


def _chunks(df: DataFrame, key: str) -> int:
    """Arrays needed so that none holds many more than ``CHUNK`` distinct stations."""
    return max(1, math.ceil(df.agg(F.approx_count_distinct(key)).first()[0] / CHUNK))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def knn_join(
    targets: DataFrame,
    refs: DataFrame,
    k: int,
    target_key: str,
    ref_key: str,
    cell: float,
    levels: int = 14,
) -> DataFrame:
    """The ``k`` nearest reference rows of every target, exact, ties by reference key.

    Both sides have ``x, y``. For each occupied target cell the finest grid level is chosen whose 3×3 block holds at
    least ``k`` references; then the k-th neighbour lies within 2·sqrt(2) cell sides, that is inside the 7×7 block. Only
    the cells needed by some target are packed, in arrays of bounded size, and each array gives at most ``k`` candidates.
    Where references are denser than about ``k`` in a cell of side ``cell``, the grid begins with finer cells; of references at one position
    only the first ``k`` by key can count.
    """
    refs = refs.select(F.col(ref_key), F.col("x").cast("double"), F.col("y").cast("double"))
    refs = refs.withColumn("_rn", F.row_number().over(Window.partitionBy("x", "y").orderBy(ref_key))).filter(F.col("_rn") <= k).drop("_rn")
    held = refs.groupBy(*[F.floor(F.col(v) / F.lit(cell)).alias(f"_c{v}") for v in "xy"]).agg(F.count(F.lit(1)).alias("n"))
    crowd = (held.agg(F.max("n")).first()[0] or 1) / k
    finer = min(FINER, max(0, math.ceil(math.log2(crowd) / 2))) if crowd > 1 else 0
    cell, levels = cell / 2**finer, levels + finer

    def axis(v: str) -> Column:
        return F.floor(F.col(v) / F.lit(cell)).cast("long")

    fine = refs.withColumns({"_cx": axis("x"), "_cy": axis("y")})
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    counts = (
        fine.groupBy("_cx", "_cy")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_lv", lv)
        .groupBy("_lv", F.expr("shiftright(_cx, _lv)").alias("_cx"), F.expr("shiftright(_cy, _lv)").alias("_cy"))
        .agg(F.sum("n").alias("n"))
    )
    placed = _dealt(targets.select(target_key, "x", "y"), target_key).withColumns({"_tx": axis("x"), "_ty": axis("y")})
    occupied = placed.select("_tx", "_ty").distinct()
    block = (
        occupied.withColumn("_lv", lv)
        .withColumn("_dx", F.explode(_neighbour_offsets(1)))
        .withColumn("_dy", F.explode(_neighbour_offsets(1)))
        .withColumns(
            {"_cx": F.expr("shiftright(_tx, _lv) + _dx"), "_cy": F.expr("shiftright(_ty, _lv) + _dy")}
        )
    )
    enough = (
        block.join(counts, ["_lv", "_cx", "_cy"])
        .groupBy("_tx", "_ty", "_lv")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= k)
        .groupBy("_tx", "_ty")
        .agg(F.min("_lv").alias("_lv"))
    )
    # no level holds k references: take them all, as level ``levels`` with the single cell (0, 0)
    chosen = occupied.join(enough, ["_tx", "_ty"], "left").withColumn("_lv", F.coalesce("_lv", F.lit(levels)))
    wide = F.when(F.col("_lv") < levels, _neighbour_offsets(3)).otherwise(F.array(F.lit(0)))
    wanted = (
        chosen.withColumn("_dx", F.explode(wide))
        .withColumn("_dy", F.explode(wide))
        .withColumns(
            {
                "_cx": F.when(F.col("_lv") < levels, F.expr("shiftright(_tx, _lv) + _dx")).otherwise(F.lit(0)),
                "_cy": F.when(F.col("_lv") < levels, F.expr("shiftright(_ty, _lv) + _dy")).otherwise(F.lit(0)),
            }
        )
        .drop("_dx", "_dy")
    )
    needed = wanted.select("_lv", "_cx", "_cy").distinct()
    chunks = _chunks(refs, ref_key)
    packed = (
        fine.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels))))
        .withColumns(
            {
                "_cx": F.when(F.col("_lv") < levels, F.expr("shiftright(_cx, _lv)")).otherwise(F.lit(0)),
                "_cy": F.when(F.col("_lv") < levels, F.expr("shiftright(_cy, _lv)")).otherwise(F.lit(0)),
            }
        )
        .join(needed, ["_lv", "_cx", "_cy"], "left_semi")
        .groupBy("_lv", "_cx", "_cy", _bucket(F.col(ref_key), chunks).alias("_ch"))
        .agg(F.collect_list(F.struct("x", "y", F.col(ref_key).alias("id"))).alias("_refs"))
    )
    # the arrays around a cell of targets are put together, again up to a bounded size
    arrays = cut_lineage(wanted.join(packed, ["_lv", "_cx", "_cy"]).select("_tx", "_ty", "_refs"))
    sizes = arrays.groupBy("_tx", "_ty").agg(F.ceil(F.sum(F.size("_refs")) / CHUNK).cast("int").alias("_n"))
    part = F.pmod(F.xxhash64(F.get("_refs", F.lit(0))["id"]), F.col("_n"))
    candidates = arrays.join(sizes, ["_tx", "_ty"]).groupBy("_tx", "_ty", part.alias("_part")).agg(F.flatten(F.collect_list("_refs")).alias("_refs")).drop("_part")

    def scored(tx: Column, ty: Column) -> Column:
        def one(r: Column) -> Column:
            dx, dy = r["x"] - tx, r["y"] - ty
            return F.struct((dx * dx + dy * dy).alias("d2"), r["id"].alias("id"))

        return _smallest(F.transform(F.col("_refs"), one), "d2", k)

    best = (
        placed.select(target_key, "x", "y", "_tx", "_ty")
        .join(candidates, ["_tx", "_ty"])
        .select(target_key, scored(F.col("x"), F.col("y")).alias("_top"))
        .groupBy(target_key)
        .agg(F.slice(F.sort_array(F.flatten(F.collect_list("_top"))), 1, k).alias("_top"))
    )
    return best.select(target_key, F.posexplode("_top").alias("_pos", "_hit")).select(
        target_key,
        F.col("_hit.id").alias(ref_key),
        F.sqrt("_hit.d2").alias("distance"),
        (F.col("_pos") + 1).alias("rank"),
    )


def _smallest(scored: Column, field: str, k: int) -> Column:
    """The ``k`` smallest structs in order. Only the plain distances are sorted whole; structs up to the k-th are kept."""

    def pick(items: Column) -> Column:
        limit = F.sort_array(F.transform(items, lambda s: s[field]))
        nth = F.get(limit, F.least(F.lit(k), F.size(items)) - 1)
        near = R.let(nth, lambda d: F.filter(items, lambda s: s[field] <= d))
        return F.slice(F.sort_array(near), 1, k)

    return R.let(scored, pick)


def _dealt(targets: DataFrame, key: str) -> DataFrame:
    """Targets spread evenly over tasks: the work per target is large compared with its row."""
    return targets.repartition(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _nearest_means(
    targets: np.ndarray, stations: np.ndarray, values: np.ndarray, power: float, radii: tuple[float, ...], min_n: int, max_n: int
) -> np.ndarray:
    """Inverse-distance means of one group by target; NaN without coverage.

    ``targets`` and ``stations`` are coordinates, ``values`` the stations' values. Stations are in the order of their keys, which decides ties.
    """
    out = np.full(len(targets), np.nan)
    at_once = max(1, ELEMENTS // len(stations))
    for begin in range(0, len(targets), at_once):
        part = targets[begin : begin + at_once]
        dx, dy = (stations[None, :, k] - part[:, None, k] for k in (0, 1))
        distance = np.sqrt(dx * dx + dy * dy)
        rows = np.arange(len(part))
        near, found = np.full((max_n, len(part)), np.nan), np.full((max_n, len(part)), np.nan)
        for k in range(min(max_n, len(stations))):
            nearest = distance.argmin(1)  # the first of equal ones
            d = distance[rows, nearest]
            near[k] = np.where(d <= max(radii), d, np.nan)
            found[k] = values[nearest]
            distance[rows, nearest] = np.inf
        limit = near[min_n - 1]
        radius = np.full(limit.shape, np.nan)
        for r in sorted(radii, reverse=True):
            radius = np.where(limit <= r, r, radius)
        top, bottom = np.zeros(limit.shape), np.zeros(limit.shape)
        for k in range(max_n):
            weight = np.where(near[k] <= radius, 1.0 / np.maximum(near[k], 1e-12) ** power, 0.0)
            top += np.where(weight > 0, weight * found[k], 0.0)
            bottom += weight
        with np.errstate(invalid="ignore", divide="ignore"):
            out[begin : begin + at_once] = np.where(np.isnan(radius), np.nan, top / bottom)
    return out


def _at_level(level: Column, column: str) -> Column:
    """Cell of a level from a cell of the finest one."""
    return F.call_function("shiftright", F.col(column), F.lit(LEVELS) - level)


def idw_adaptive(
    targets: DataFrame,
    values: DataFrame,
    target_key: str,
    station_key: str,
    group: list[str],
    power: Column,
    radii: tuple[float, ...] = RADII_KM,
    min_n: int = MIN_NEIGHBOURS,
    max_n: int = MAX_NEIGHBOURS,
    listed: int = LISTED,
    wide: tuple[str, list[str]] | None = None,
) -> DataFrame:
    """Inverse-distance value of every target for every group (date, variable …), null without coverage.

    ``values``: station key, ``x, y``, ``valor`` and the group columns, one row per station and group. ``power`` may use group columns. The nearest
    ``max_n`` stations with a value within the largest radius count, those inside the first radius that holds ``min_n`` of them. With ``wide``, a
    group column and names of its groups, each target key with a position comes back once with a column per name, so that no long form is shuffled.

    Blocks are the widest cells that hold at most about ``TARGETS`` targets and ``listed`` values of any one group; the widest of all is as wide as the
    largest radius. For each block and group the finest level is taken whose 3 x 3 cells hold ``max_n`` values: the nearest ones then lie in its
    7 x 7 cells, and only these values meet the block. Where no level has enough, the 3 x 3 cells of the widest level do. So what a block
    receives depends on ``max_n`` and not on how many stations there are.
    """
    reach = max(radii) * (1 + 1e-9)
    axis = lambda v: F.floor(F.col(v) * F.lit(2**LEVELS / reach)).cast("long")
    gid = F.xxhash64(*group)
    clean = cut_lineage(
        values.groupBy(F.col(station_key).alias("_id"), *group)
        .agg(*[F.first(F.col(c).cast("double")).alias(n) for c, n in (("valor", "_v"), ("x", "_x"), ("y", "_y"))])
        .withColumns({"_gid": gid, "_fx": axis("_x"), "_fy": axis("_y"), "_power": power.cast("double")})
    )
    groups = clean.select("_gid", *group, "_power").distinct()
    clean = clean.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("_v", "_x", "_y"))).select("_gid", "_id", "_x", "_y", "_v", "_fx", "_fy")
    placed = targets.select(target_key, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    if wide:
        placed = placed.dropDuplicates([target_key])
    placed = placed.withColumns({"_fx": axis("_x"), "_fy": axis("_y")})

    def at_levels(fine: DataFrame, keys: list[str]) -> DataFrame:
        """Counts of fine cells as counts of the cells of every level."""
        every = fine.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        return every.withColumns({"_cx": _at_level(F.col("_lv"), "_fx"), "_cy": _at_level(F.col("_lv"), "_fy")}).groupBy("_lv", "_cx", "_cy", *keys).agg(F.sum("n").alias("n"))

    held = at_levels(clean.groupBy("_fx", "_fy", "_gid").agg(F.count(F.lit(1)).alias("n")), ["_gid"])
    occupied = placed.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("n"))
    dense = held.groupBy("_lv", "_cx", "_cy").agg(F.max("n").alias("_most"))
    fits = (
        at_levels(occupied, [])
        .join(dense, ["_lv", "_cx", "_cy"], "left")
        .where(((F.col("n") <= TARGETS) & (F.coalesce("_most", F.lit(0)) <= listed)) | (F.col("_lv") == LEVELS))
        .select("_lv", "_cx", "_cy", F.ceil(F.col("n") / TARGETS).cast("int").alias("_chunks"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    chosen = cut_lineage(
        occupied.withColumn("_lv", levels)
        .withColumns({"_cx": _at_level(F.col("_lv"), "_fx"), "_cy": _at_level(F.col("_lv"), "_fy")})
        .join(fits, ["_lv", "_cx", "_cy"])
        .groupBy("_fx", "_fy")
        .agg(F.min(F.struct("_lv", "_cx", "_cy", "_chunks")).alias("_b"))
        .select("_fx", "_fy", "_b.*")
    )
    cell = ["_lv", "_cx", "_cy"]
    cells = chosen.select(*cell, "_chunks").distinct()
    up = lambda c, level: F.call_function("shiftright", F.col(c), F.col("_lv") - level)

    # finest level per block and group with enough values around; 0 where there is none
    around = cells.select(*cell, F.explode(F.sequence(F.lit(0), F.col("_lv"))).alias("_wl")).where("_wl >= 2")
    around = around.withColumn("_dx", F.explode(_neighbour_offsets(1))).withColumn("_dy", F.explode(_neighbour_offsets(1)))
    around = around.withColumns({"_wx": up("_cx", F.col("_wl")) + F.col("_dx"), "_wy": up("_cy", F.col("_wl")) + F.col("_dy")})
    enough = (
        around.join(held.select(F.col("_lv").alias("_wl"), F.col("_cx").alias("_wx"), F.col("_cy").alias("_wy"), "_gid", "n"), ["_wl", "_wx", "_wy"])
        .groupBy(*cell, "_gid", "_wl")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max_n)
        .groupBy(*cell, "_gid")
        .agg(F.max("_wl").alias("_wl"))
    )
    blocks = F.lit(1) if wide else F.greatest(F.ceil(groups.agg(F.count(F.lit(1))).scalar() / GROUPS), F.lit(1)).cast("int")
    heads = cut_lineage(
        cells.withColumn("_gid", F.explode(groups.agg(F.collect_list("_gid")).scalar()))
        .join(enough, [*cell, "_gid"], "left")
        .withColumns({"_wl": F.coalesce("_wl", F.lit(0)), "_block": F.pmod("_gid", blocks).cast("int"), "_chunk": F.sequence(F.lit(0), F.col("_chunks") - 1)})
        .drop("_chunks")
    )
    offsets = F.when(F.col("_wl") == 0, _neighbour_offsets(1)).otherwise(_neighbour_offsets(3))
    wanted = heads.withColumn("_dx", F.explode(offsets)).withColumn("_dy", F.explode(offsets))
    wanted = wanted.withColumns({"_wx": up("_cx", F.col("_wl")) + F.col("_dx"), "_wy": up("_cy", F.col("_wl")) + F.col("_dy")}).drop("_dx", "_dy")
    there = ["_wl", "_wx", "_wy", "_gid"]
    packed = (
        clean.withColumn("_wl", F.explode(heads.agg(F.collect_set("_wl")).scalar()))
        .withColumns({"_wx": _at_level(F.col("_wl"), "_fx"), "_wy": _at_level(F.col("_wl"), "_fy")})
        .join(wanted.select(*there).distinct(), there, "left_semi")
        .groupBy(*there)
        .agg(F.collect_list(F.struct("_id", "_x", "_y", "_v")).alias("_s"))
    )
    keys = [*cell, "_chunk", "_block"]
    none = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in [*group, "_power"]]
    stations = wanted.join(packed, there).select(*cell, F.explode("_chunk").alias("_chunk"), "_block", "_gid", *none, *[F.col("_s")[c].alias(c) for c in ("_id", "_x", "_y", "_v")])
    # every block also knows its groups: they come back for targets without any station
    own = heads.withColumn("_chunk", F.explode("_chunk")).join(groups, "_gid")
    own = own.select(*keys, "_gid", *group, "_power", *[F.lit(None).cast(stations.schema[c].dataType).alias(c) for c in ("_id", "_x", "_y", "_v")])
    right = stations.union(own)
    left = (
        placed.join(chosen, ["_fx", "_fy"])
        .withColumn("_chunk", F.pmod(F.xxhash64(F.lit("chunk"), target_key), F.col("_chunks")).cast("int"))
        .withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(*keys, target_key, "_x", "_y")
    )

    def interpolate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        is_head = right["_v"].isna()
        heads, held = right[is_head].sort_values("_gid"), right[~is_head]
        place = {g: i for i, g in enumerate(heads["_gid"])}
        out = np.full((len(left), len(heads)), np.nan)
        at, powers = left[["_x", "_y"]].to_numpy(), heads["_power"].to_numpy()
        for g, rows in held.groupby("_gid") if len(left) else ():
            order = pd.Series(np.concatenate(rows["_id"].to_numpy())).sort_values(kind="stable").index.to_numpy()
            x, y, v = (np.concatenate(rows[c].to_numpy())[order] for c in ("_x", "_y", "_v"))
            out[:, place[g]] = _nearest_means(at, np.column_stack([x, y]), v, powers[place[g]], radii, min_n, max_n)
        if wide:
            columns = {name: i for i, name in enumerate(heads[wide[0]])}
            return pd.DataFrame({target_key: left[target_key], **{n: out[:, columns[n]] if n in columns else np.full(len(left), np.nan) for n in wide[1]}})
        rows = np.repeat(np.arange(len(left)), len(heads))
        frame = {target_key: left[target_key].to_numpy()[rows]}
        frame |= {c: np.tile(heads[c].to_numpy(), len(left)) for c in group}
        flat = pd.Series(out.reshape(-1))
        return pd.DataFrame(frame).assign(valor=flat.astype(object).where(flat.notna(), None))

    kinds = {f.name: f.dataType.simpleString() for f in [*targets.schema.fields, *values.schema.fields]}
    kinds[target_key] = targets.schema[target_key].dataType.simpleString()
    schema = ", ".join([f"`{target_key}` {kinds[target_key]}", *([f"`{n}` double" for n in wide[1]] if wide else [*(f"`{c}` {kinds[c]}" for c in group), "valor double"])])
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(interpolate, schema)
    return out.select(target_key, *[F.nanvl(F.col(f"`{n}`"), F.lit(None)).alias(n) for n in wide[1]]) if wide else out


def power_of(variable: Column, default: float = 2.5) -> Column:
    chain = F.lit(default)
    for name, value in IDW_POWERS.items():
        chain = F.when(variable == name, F.lit(value)).otherwise(chain)
    return chain


def usable_values(daily: DataFrame, variables: list[str]) -> DataFrame:
    """Long form (station, date, variable, valor): nulls out, and zero out for reference evapotranspiration."""
    long = daily.unpivot(["estacion_id", "fecha"], variables, "variable", "valor").filter("valor IS NOT NULL")
    return long.filter((F.col("variable") != "etpmon") | (F.col("valor") > 0))


def weighted_surface(
    cells: DataFrame, stations: DataFrame, cell_key: str, station_key: str, power: float = 2.0
) -> DataFrame:
    """Inverse-distance value of every cell from all stations, and the distance to the nearest one.

    Stations are packed in arrays of bounded size; a cell meets each array once, keyed by array number and salt, and
    partial sums are added per cell. The work is cells × stations by definition, but no pair becomes a row.
    """
    chunks = _chunks(stations, station_key)
    packed = (
        stations.groupBy(_bucket(F.col(station_key), chunks).alias("_ch"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(station_key).alias("id"), "x", "y", "valor"))).alias("_st"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    spread = _dealt(cells.select(cell_key, F.col("x").alias("_x"), F.col("y").alias("_y")), cell_key).withColumns(
        {"_salt": _bucket(F.col(cell_key), SALTS), "_ch": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))}
    )

    def distance(s: Column) -> Column:
        dx, dy = s["x"] - F.col("_x"), s["y"] - F.col("_y")
        return F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12))

    weight = lambda s: 1.0 / F.pow(distance(s), F.lit(power))
    partial = spread.join(packed, ["_ch", "_salt"]).select(
        cell_key,
        F.aggregate("_st", F.lit(0.0), lambda acc, s: acc + weight(s) * s["valor"]).alias("_top"),
        F.aggregate("_st", F.lit(0.0), lambda acc, s: acc + weight(s)).alias("_bottom"),
        F.array_min(F.transform("_st", distance)).alias("_d"),
    )
    return partial.groupBy(cell_key).agg(
        (F.sum("_top") / F.sum("_bottom")).alias("valor"), F.min("_d").alias("distancia")
    )


def make_grid(
    spark, minx: float, miny: float, maxx: float, maxy: float, res_x: float, res_y: float, margin: float = 0.0
) -> DataFrame:
    """Cell centres, row 0 at the top; the number of columns and rows is truncated."""
    minx, miny, maxx, maxy = minx - margin, miny - margin, maxx + margin, maxy + margin
    ncols, nrows = int((maxx - minx) / res_x), int((maxy - miny) / res_y)
    top = miny + nrows * res_y
    return spark.range(ncols * nrows).select(
        F.col("id").alias("cell"),
        F.floor(F.col("id") / ncols).alias("r"),
        (F.col("id") % ncols).alias("c"),
        (F.lit(minx) + (F.col("id") % ncols + 0.5) * res_x).alias("x"),
        (F.lit(top) - (F.floor(F.col("id") / ncols) + 0.5) * res_y).alias("y"),
    )


def grid_over(extent: DataFrame, res_x: float, res_y: float) -> DataFrame:
    """Cell centres over a one-row extent (``minx, miny, maxx, maxy``); rows and columns explode inside Spark."""
    sized = extent.withColumns(
        {
            "_nc": F.floor((F.col("maxx") - F.col("minx")) / res_x).cast("int"),
            "_nr": F.floor((F.col("maxy") - F.col("miny")) / res_y).cast("int"),
        }
    )
    rows = sized.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)))
    # spread rows over tasks before the columns explode
    rows = rows.repartition(F.col("r"))
    cells = rows.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
    return cells.select(
        (F.col("r").cast("long") * F.col("_nc") + F.col("c")).alias("cell"),
        "r",
        "c",
        (F.col("minx") + (F.col("c") + 0.5) * res_x).alias("x"),
        (F.col("miny") + F.col("_nr") * res_y - (F.col("r") + 0.5) * res_y).alias("y"),
    )


def validate_against_stations(
    stations: DataFrame,
    plots: DataFrame,
    interpolated: DataFrame,
    plot_key: str,
    station_key: str,
    cell: float,
    threshold: Column,
) -> DataFrame:
    """Per station and variable: nearest plot, its value, difference, distance in km (degrees × 111), alert flag.

    ``stations``: key, ``x, y, variable, valor``; ``plots``: key, ``x, y``; ``interpolated``: plot key, ``variable, valor``.
    """
    nearest = knn_join(
        stations.select(station_key, "x", "y").distinct(), plots, 1, station_key, plot_key, cell
    ).select(station_key, plot_key, (F.col("distance") * 111).alias("dist_km"))
    value = interpolated.select(plot_key, "variable", F.col("valor").alias("interpolado"))
    real = stations.select(station_key, "variable", F.col("valor").alias("valor_real"))
    diff = F.abs(F.col("valor_real") - F.col("interpolado"))
    return (
        real.join(nearest, station_key)
        .join(value, [plot_key, "variable"], "left")
        .withColumns({"diff": diff, "alerta": F.coalesce(diff > threshold, F.lit(False))})
    )


def threshold_of(variable: Column) -> Column:
    chain = F.lit(DEFAULT_THRESHOLD)
    for name, value in CHECK_THRESHOLDS.items():
        chain = F.when(variable == name, F.lit(value)).otherwise(chain)
    return chain


# Column prefixes of the lag frame.
LAG_PREFIX = {"tempmedia": "Tp", "humedadmedia": "Hd", "etpmon": "Ev"}


def lag_names(prefix: str, days: int = 14) -> list[str]:
    return [f"{prefix}_t-{d}" for d in range(days, 0, -1)] + [f"{prefix}_t"]


def lag_features(plots: DataFrame, daily: DataFrame, run_date: Column, plot_key: str, days: int = 14) -> DataFrame:
    """One row per plot: each variable interpolated on the run date and the ``days`` before, null when missing.

    ``daily``: station key, ``x, y``, ``fecha`` and the variables.
    """
    window = daily.filter((F.col("fecha") <= run_date) & (F.col("fecha") >= F.date_sub(run_date, days)))
    lagged = window.withColumn("lag", F.datediff(run_date, F.col("fecha")))
    variables = list(LAG_PREFIX)
    long = lagged.unpivot(["estacion_id", "x", "y", "lag"], variables, "variable", "valor").filter(
        "valor IS NOT NULL AND (variable <> 'etpmon' OR valor > 0)"
    )
    named = F.concat(
        F.element_at(F.create_map(*[F.lit(v) for kv in LAG_PREFIX.items() for v in kv]), F.col("variable")),
        F.when(F.col("lag") == 0, F.lit("_t")).otherwise(F.concat(F.lit("_t-"), F.col("lag").cast("string"))),
    )
    names = [n for prefix in LAG_PREFIX.values() for n in lag_names(prefix, days)]
    values = long.withColumn("columna", named)
    wide = idw_adaptive(plots, values, plot_key, "estacion_id", ["columna", "variable"], power_of(F.col("variable")), wide=("columna", names))
    rounded = wide.select(plot_key, *[fixed(F.col(f"`{n}`"), 3).alias(n) for n in names])
    return plots.select(plot_key).join(rounded, plot_key, "left")


def eto_history(
    plots: DataFrame, daily: DataFrame, run_date: Column, plot_key: str, variables: list[str], days: int = 12
) -> DataFrame:
    """``eto_0 … eto_12`` (days back) and the other variables of the run date, three decimals."""
    recent = daily.filter((F.col("fecha") <= run_date) & (F.col("fecha") >= F.date_sub(run_date, days)))
    lag = F.datediff(run_date, F.col("fecha"))
    eto = recent.select("estacion_id", "x", "y", F.concat(F.lit("eto_"), lag.cast("string")).alias("columna"), F.lit("etpmon").alias("variable"), F.col("etpmon").alias("valor")).filter("valor > 0")
    other = (
        recent.filter(lag == 0)
        .unpivot(["estacion_id", "x", "y"], variables, "variable", "valor")
        .select("estacion_id", "x", "y", F.col("variable").alias("columna"), "variable", "valor")
        .filter("valor IS NOT NULL")
    )
    names = [f"eto_{d}" for d in range(days + 1)] + variables
    wide = idw_adaptive(
        plots, eto.unionByName(other), plot_key, "estacion_id", ["columna", "variable"], power_of(F.col("variable"), 3.0), wide=("columna", names)
    )
    return plots.select(plot_key).join(wide.select(plot_key, *[fixed(n, 3).alias(n) for n in names]), plot_key, "left")
