"""Crop coefficients, irrigation need, dose and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions import rules
from fieldspark.functions.numbers import fixed, whole
from fieldspark.functions.text import norm_text


def with_kc_entry(plots: DataFrame, catalog: DataFrame, crop: str = "cultivo") -> DataFrame:
    """Catalogue entry of each crop by accent-free upper name; the default entry where there is none.

    Spark broadcasts the catalogue when it is small; a larger one is joined by key.
    """
    code, low, high, trust = rules.DEFAULT_KC
    keyed = catalog.select(
        norm_text(F.col("cultivo")).alias("_k"),
        F.upper(F.trim("formula_code")).alias("formula_code"),
        "kc_min",
        "kc_max",
        "confianza",
    ).dropDuplicates(["_k"])
    return (
        plots.withColumn("_k", norm_text(F.col(crop)))
        .join(keyed, "_k", "left")
        .withColumns(
            {
                "formula_code": F.coalesce("formula_code", F.lit(code)),
                "kc_min": F.coalesce("kc_min", F.lit(low)),
                "kc_max": F.coalesce("kc_max", F.lit(high)),
                "confianza": F.coalesce("confianza", F.lit(trust)),
            }
        )
        .drop("_k")
    )


def with_kc(df: DataFrame) -> DataFrame:
    return df.withColumn("kc", rules.kc_from_ndvi(F.col("ndvi"), F.col("formula_code"), F.col("kc_min"), F.col("kc_max")))


def irrigation_need(df: DataFrame) -> DataFrame:
    """From ``etp, kc, ev_t, area_m2``: need, deficit, volumes, label and map colour."""
    need = fixed(F.col("etp") * F.col("kc"), 3)
    deficit = F.greatest(F.lit(0.0), F.col("riego_mm"))
    return (
        df.withColumn("riego_mm", need)
        .withColumn("deficit_mm", deficit)
        .withColumns(
            {
                "m3_ha": fixed(F.col("deficit_mm") * 10, 2),
                "superficie_ha": fixed(F.col("area_m2") / 10000.0, 4),
                "litros_dia": whole(F.col("deficit_mm") * F.col("area_m2")),
                "litros_txt": rules.volume_label(F.col("deficit_mm")),
                "color": rules.reference_color(F.col("etp"), F.col("ev_t")),
            }
        )
    )


def forecast_unpivot(df: DataFrame, ids: list[str], days: list[str]) -> DataFrame:
    """One row per plot and forecast day; ``offset`` is the position of the day."""
    order = F.array(*[F.lit(d) for d in days])
    return df.unpivot(ids, days, "dia", "etp").withColumn("offset", (F.array_position(order, F.col("dia")) - 1).cast("int"))


def irrigation_dose(df: DataFrame) -> DataFrame:
    """From ``riego_mm, deficit_mm, m3_ha, superficie_ha, sistexp_cod, color``: net and gross water per plot."""
    need = F.greatest(
        F.coalesce("riego_mm", F.lit(0.0)),
        F.coalesce(F.when(F.col("deficit_mm") != 0, F.col("deficit_mm")), F.col("riego_mm"), F.lit(0.0)),
    )
    irrigated = F.trim(F.coalesce("sistexp_cod", F.lit(""))) == "R"
    efficiency = F.when(irrigated, F.lit(rules.EFFICIENCY_IRRIGATED)).otherwise(F.lit(rules.EFFICIENCY_OTHER))
    per_ha = F.coalesce("m3_ha", F.lit(0.0))
    return (
        df.filter(F.col("riego_mm").isNotNull())
        .withColumns({"demanda_mm": need, "_eff": efficiency})
        .withColumns(
            {
                "m3_ha": F.when((per_ha <= 0) & (F.col("demanda_mm") > 0), fixed(F.col("demanda_mm") * 10, 1)).otherwise(per_ha),
                "litros_netos": whole(F.col("demanda_mm") * (F.col("superficie_ha") * 10000)),
            }
        )
        .withColumns(
            {
                "m3_total_neto": fixed(F.col("litros_netos") / 1000, 1),
                "litros_brutos": F.when(
                    F.col("litros_netos") > 0, whole(F.col("litros_netos") / F.col("_eff"))
                ).otherwise(F.lit(0).cast("long")),
                "eficiencia_pct": fixed(F.col("_eff") * 100, 0).cast("int"),
                "sistexp": F.when(irrigated, "Regadío").otherwise("Secano"),
                "estado": rules.irrigation_state(F.col("color")),
                "badge": rules.irrigation_badge(F.col("color")),
            }
        )
        .withColumn("m3_total_bruto", fixed(F.col("litros_brutos") / 1000, 1))
        .drop("_eff")
    )


def irrigation_alerts(df: DataFrame, n: int = 8) -> DataFrame:
    """Irrigated plots with a red or orange forecast, highest need first, top ``n``."""
    return (
        df.filter(
            F.col("riego_mm").isNotNull()
            & (F.trim(F.coalesce("sistexp_cod", F.lit(""))) == "R")
            & F.lower(F.coalesce("color", F.lit(""))).isin("red", "orange")
        )
        .orderBy(F.desc("riego_mm"), "id_recinto")
        .limit(n)
    )


def fix_deficit(df: DataFrame) -> DataFrame:
    """Recompute deficit, volumes, label and colour from ``riego_mm`` and ``offset``."""
    need = F.col("riego_mm")
    return df.withColumns(
        {
            "deficit_mm": need,
            "m3_ha": fixed(need * 10, 2),
            "litros_dia": whole(need * F.col("superficie_ha") * 10000),
            "litros_txt": rules.volume_label(need),
            "color": rules.need_color(need, F.col("offset")),
        }
    )


def litres_fallback(df: DataFrame) -> DataFrame:
    computed = whole(F.col("deficit_mm") * F.col("superficie_ha") * 10000)
    litres = F.coalesce(F.col("litros_dia"), computed)
    return df.withColumns(
        {
            "litros": litres,
            "tiene_litros": F.coalesce(litres > 0, F.lit(False)),
            "urgencia": F.when(F.col("color").isin("red", "orange"), "Riego recomendado").otherwise("Sin recomendación"),
        }
    )


def irrigation_diagnostics(df: DataFrame) -> DataFrame:
    return df.groupBy("offset").agg(
        F.count(F.lit(1)).alias("filas"),
        F.count_if(F.col("color") == "red").alias("rojos"),
        F.count_if(F.col("riego_mm").isNull()).alias("sin_riego"),
        F.max("riego_mm").alias("riego_max"),
    )


def ndvi_fallback_chain(
    plots: DataFrame, centre: DataFrame, zonal: DataFrame, neighbours: DataFrame, key: str
) -> DataFrame:
    """Index of a plot: pixel under its centroid, zonal mean, mean of intersecting plots; with the source used.

    Every input is ``(key, ndvi)``. A plot without any of them keeps null and takes the middle of its range later.
    """
    joined = plots
    for name, df in (("_a", centre), ("_b", zonal), ("_c", neighbours)):
        joined = joined.join(df.select(key, F.col("ndvi").alias(name)), key, "left")
    source = (
        F.when(F.col("_a").isNotNull(), "centroide")
        .when(F.col("_b").isNotNull(), "zonal")
        .when(F.col("_c").isNotNull(), "recintos")
        .otherwise("rango")
    )
    return joined.withColumns({"ndvi": F.coalesce("_a", "_b", "_c"), "fuente_ndvi": source}).drop("_a", "_b", "_c")


def plot_forecast(df: DataFrame, run_date: Column) -> DataFrame:
    """Forecast rows with target date and label by real date, so a run across New Year keeps its order."""
    return df.withColumns(
        {
            "fecha": F.date_add(run_date, F.col("offset") + 1),
            "etiqueta": F.date_format(F.date_add(run_date, F.col("offset") + 1), "dd/MM"),
        }
    )
