"""Repeatable merges: insert-if-absent, upsert, dedup, deletes, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.session import number_rows


def dedup_keep_first(df: DataFrame, keys: list[str], order: list[Column], allow_missing: bool = False) -> DataFrame:
    """First row per key; the limit also runs before the shuffle. ``allow_missing`` goes by the key columns that exist."""
    present = [k for k in keys if k in df.columns] if allow_missing else keys
    w = Window.partitionBy(*present).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def new_rows(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key; null key parts equal each other, so a rerun adds nothing."""
    known = stored.select(*[F.col(k).alias(f"_stored_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in keys]
    return dedup_keep_first(incoming, keys, order).join(known, same, "left_anti")


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Stored rows are never corrected; a second run changes nothing."""
    return stored.unionByName(new_rows(stored, incoming, keys, order))


def insert_counts(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows read, inserted and skipped."""
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(1))
    per_key = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.join(known, keys, "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("leidos"),
        F.count_if(F.col("_known").isNull()).alias("insertados"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count_if(F.col("_known").isNull())).alias("omitidos"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Insert or update by key; columns in ``keep`` hold their stored value on update."""
    values = [c for c in stored.columns if c not in keys]
    left = stored.select(*keys, F.struct(*values).alias("_old"))
    right = incoming.select(*keys, F.struct(*values).alias("_new"))
    out = []
    for c in values:
        fresh, old = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        if c in keep:
            pick = F.when(F.col("_old").isNotNull(), old).otherwise(fresh)
        else:
            pick = F.when(F.col("_new").isNotNull(), fresh).otherwise(old)
        out.append(pick.alias(c))
    return left.join(right, keys, "full_outer").select(*keys, *out)


def touch_changed(stored: DataFrame, incoming: DataFrame, keys: list[str], stamp: str, now: Column) -> DataFrame:
    """Upsert that sets ``stamp`` on changed and new rows only."""
    values = [c for c in stored.columns if c not in keys and c != stamp]
    left = stored.select(*keys, F.struct(*values).alias("_old"), F.col(stamp).alias("_ts"))
    right = incoming.select(*keys, F.struct(*values).alias("_new"))
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    return left.join(right, keys, "full_outer").select(
        *keys,
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c)
            for c in values
        ],
        F.when(changed, now).otherwise(F.col("_ts")).alias(stamp),
    )


def delete_using(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys), keys, "left_anti")


def replace_groups(stored: DataFrame, incoming: DataFrame, group: str) -> DataFrame:
    """All stored rows of the groups that arrive are replaced by the incoming ones."""
    touched = incoming.select(group)
    return stored.join(touched, group, "left_anti").unionByName(incoming)


def update_from_join(rows: DataFrame, lookup: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sets ``column`` from a lookup; keys match null to null. Rows without match keep null: the orphans."""
    other = lookup.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(column).alias(f"_{column}"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    base = rows.drop(column)
    return base.join(other, cond, "left").drop(*[f"_k_{k}" for k in keys]).withColumnRenamed(f"_{column}", column)


def next_ids(stored: DataFrame, fresh: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """New rows numbered on from the largest stored key."""
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top")).scalar()
    return number_rows(fresh, order, "_pos").withColumn(key, (top + F.col("_pos")).cast("long")).drop("_pos")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_dates(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.select(*keys).join(stored.select(*keys), keys, "left_anti")


def backfill(daily: DataFrame, last: Column, days: int = 15) -> DataFrame:
    return daily.filter((F.col("fecha") > F.date_sub(last, days)) & (F.col("fecha") <= last))


def resolve_requests(requests: DataFrame, plots: DataFrame) -> DataFrame:
    """Outcome of pending ownership requests.

    Removal needs a reason and frees the plot; acceptance of a plot owned by somebody else is rejected; of several
    acceptances for a free plot the first one wins.
    """
    kind = F.lower(F.trim(F.coalesce("tipo_solicitud", F.lit("aceptacion"))))
    joined = requests.withColumn("_kind", kind).join(
        plots.select("id_recinto", F.col("id_propietario").alias("_owner")), "id_recinto", "left"
    )
    pending = F.col("estado") == "pendiente"
    claim = pending & (F.col("_kind") == "aceptacion") & F.col("_owner").isNull()
    winners = (
        joined.filter(claim).groupBy("id_recinto").agg(F.min("id_solicitud").alias("_winner"))
    )
    reason = F.trim(F.coalesce("motivo_solicitud", F.lit("")))
    removal = F.col("_kind") == "eliminacion"
    foreign = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("id_usuario"))
    lost = F.col("_owner").isNull() & (F.col("_winner") != F.col("id_solicitud"))
    state = (
        F.when(~pending, F.col("estado"))
        .when(removal & (reason == ""), "pendiente")
        .when(removal, "aprobada")
        .when(foreign | lost, "rechazada")
        .otherwise("aprobada")
    )
    note = F.when(pending & ~removal & (foreign | lost), "El recinto ya tiene propietario.")
    return joined.join(winners, "id_recinto", "left").select(
        "id_solicitud", "id_recinto", "id_usuario", state.alias("estado"), note.alias("motivo_rechazo")
    )
