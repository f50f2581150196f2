"""Searches, pages and sorted listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.text import blank_to_null, numeric_text_rank


def active_entries(catalog: DataFrame, today: Column) -> DataFrame:
    return catalog.filter(F.col("fecha_baja").isNull() | (F.col("fecha_baja") > today))


def typeahead(catalog: DataFrame, text: str, today: Column, fields: list[str], limit: int | None = 50) -> DataFrame:
    """Active entries with the text in any field, numeric codes first, then name."""
    pattern = f"%{text}%"
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.col(f).ilike(pattern)
    found = active_entries(catalog, today).filter(hit).orderBy(numeric_text_rank(F.col("codigo")), "nombre", "codigo")
    return found.limit(limit) if limit else found


def page(df: DataFrame, search: str, fields: list[str], order: list[Column], offset: int, size: int) -> DataFrame:
    """One page of the rows that match, each with the whole and the matching row count.

    Counts come from scalar subqueries; the page itself is a bounded top-k.
    """
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.col(f).ilike(f"%{search}%")
    found = df.filter(hit)
    total = df.agg(F.count(F.lit(1))).scalar()
    matching = found.agg(F.count(F.lit(1))).scalar()
    return found.orderBy(*order).offset(offset).limit(size).withColumns(
        {"total": total, "filtrados": matching}
    )


def catalog_label(name: Column, description: Column, code: Column) -> Column:
    return F.coalesce(blank_to_null(name), blank_to_null(description), code)


def quota(rows: DataFrame, existing: DataFrame, owner: str, order: list[Column], limit: int = 10) -> DataFrame:
    """The first ``limit − existing`` rows per owner."""
    from pyspark.sql import Window

    held = existing.groupBy(owner).agg(F.count(F.lit(1)).alias("_held"))
    w = Window.partitionBy(owner).orderBy(*order)
    first = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return (
        first.join(held, owner, "left")
        .filter(F.col("_rn") + F.coalesce("_held", F.lit(0)) <= limit)
        .drop("_rn", "_held")
    )
