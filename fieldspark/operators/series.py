"""Vegetation-index series per plot and campaign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions import dates as D
from fieldspark.functions.numbers import fixed


def latest_ndvi(series: DataFrame) -> DataFrame:
    """Last non-null mean per plot, undated rows last; ties by id."""
    order = F.struct(
        F.col("fecha_ndvi").isNotNull(), F.coalesce("fecha_ndvi", F.to_date(F.lit("0001-01-01"))), F.col("id_indice")
    )
    return (
        series.filter("valor_medio IS NOT NULL")
        .groupBy("id_recinto")
        .agg(F.max_by("valor_medio", order).alias("ndvi"), F.max("fecha_ndvi").alias("fecha_ndvi"))
    )


def ndvi_series(series: DataFrame) -> DataFrame:
    dated = series.filter("fecha_ndvi IS NOT NULL AND valor_medio IS NOT NULL")
    return dated.select(
        "id_recinto",
        "id_indice",
        "fecha_ndvi",
        fixed(F.col("valor_medio"), 2).alias("valor"),
        F.date_format("fecha_ndvi", "dd/MM/yyyy").alias("etiqueta"),
    )


def sanitize(series: DataFrame) -> DataFrame:
    """Missing values become 0; the maximum is at least and the minimum at most the mean."""
    mean = F.coalesce("valor_medio", F.lit(0.0))
    high = F.greatest(F.coalesce("valor_max", F.lit(0.0)), mean)
    low = F.least(F.coalesce("valor_min", F.lit(0.0)), mean)
    return series.withColumns(
        {"valor_medio": mean, "valor_min": F.least(low, high), "valor_max": F.greatest(low, high)}
    )


def campaigns(series: DataFrame, last_year: Column, n: int = 3) -> DataFrame:
    """Rows of the ``n`` latest campaigns with campaign year, name and day index."""
    year = D.campaign_year(F.col("fecha_ndvi"))
    return (
        series.filter((F.col("fecha_ndvi") >= D.campaign_start(last_year - (n - 1))) & (F.col("fecha_ndvi") <= D.campaign_end(last_year)))
        .withColumn("campania", year)
        .withColumns({"nombre": D.campaign_name(F.col("campania")), "dia": D.campaign_day(F.col("fecha_ndvi"))})
    )


def campaign_stats(series: DataFrame, keys: list[str]) -> DataFrame:
    return (
        series.filter("valor_medio IS NOT NULL")
        .groupBy(*keys)
        .agg(
            # the sum is exact in decimals, so the mean does not depend on the order of the rows
            fixed(F.sum(F.col("valor_medio").cast("decimal(10,4)")).cast("double") / F.count("valor_medio"), 3).alias("promedio"),
            fixed(F.max("valor_medio"), 3).alias("maximo"),
            fixed(F.min("valor_medio"), 3).alias("minimo"),
        )
    )


def nearest_dated(
    targets: DataFrame, images: DataFrame, key: list[str], margin: int = 10, bucket_key: str = "id_recinto"
) -> DataFrame:
    """For each target (plot, ``objetivo``) the nearest image within ``margin`` days, clipped to ``desde``/``hasta``.

    Dates fall into buckets as wide as the margin; a target looks at three of them. The join is an equi-join on plot and
    bucket, so a plot with very many images is split by date.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    wide = margin + 1
    shifted = targets.withColumn(
        "_b", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(day("objetivo") / wide) + d))
    )
    placed = images.filter("ruta_ndvi IS NOT NULL").select(
        bucket_key, "id_indice", "fecha_ndvi", F.floor(day("fecha_ndvi") / wide).alias("_b")
    )
    gap = F.abs(F.datediff("fecha_ndvi", "objetivo"))
    pairs = shifted.join(placed, [bucket_key, "_b"]).filter(
        (gap <= margin) & (F.col("fecha_ndvi") >= F.col("desde")) & (F.col("fecha_ndvi") <= F.col("hasta"))
    )
    order = F.struct(gap, F.col("id_indice"))
    return pairs.groupBy(*key).agg(
        F.min_by("id_indice", order).alias("id_indice"),
        F.min_by("fecha_ndvi", order).alias("fecha_ndvi"),
        F.min(gap).alias("dias"),
    )


def compare_plots(series: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sanitised measurements of the wanted plots, sorted by plot and date; one row per measurement."""
    rows = series.filter("fecha_ndvi IS NOT NULL").join(wanted.select("id_recinto"), "id_recinto", "left_semi")
    return (
        sanitize(rows)
        .select("id_recinto", "fecha_ndvi", "id_indice", "valor_medio", "valor_min", "valor_max")
        .orderBy("id_recinto", "fecha_ndvi", "id_indice")
    )


def station_days(daily: DataFrame, today: Column) -> DataFrame:
    return (
        daily.filter(F.col("fecha") < today)
        .select("estacion_id", "fecha")
        .distinct()
        .orderBy("estacion_id", F.desc("fecha"))
    )
