"""Row rules as boolean columns; rows that break one go to a rejects table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _passes(rule: Column) -> Column:
    """A rule over missing values passes, as a CHECK constraint does."""
    return F.coalesce(rule, F.lit(True))


def operation_rules() -> dict[str, Column]:
    def at_least_zero(c: str) -> Column:
        return F.col(c) >= 0

    return {
        "ok_fechas": F.col("fecha_fin") >= F.col("fecha_inicio"),
        "ok_volumen": at_least_zero("volumen"),
        "ok_horas": at_least_zero("horas"),
        "ok_dosis": at_least_zero("dosis"),
        "ok_npk": at_least_zero("n") & at_least_zero("p") & at_least_zero("k"),
        "ok_temperatura": (F.col("temperatura") > -50) & (F.col("temperatura") < 80),
    }


def crop_rules() -> dict[str, Column]:
    origin = F.col("origen_cultivo")
    product, custom = F.col("cod_producto"), F.col("cultivo_custom")
    kind, campaign = F.col("tipo_registro"), F.col("campana")
    return {
        "ok_sistema": F.col("sistema_explotacion").isin("S", "R"),
        "ok_tipo": kind.isin("CAMPANA", "IMPLANTACION"),
        "ok_origen": ((origin == "F") & product.isNotNull() & custom.isNull())
        | ((origin == "C") & product.isNull() & custom.isNotNull()),
        "ok_fechas_tipo": ((kind == "IMPLANTACION") & F.col("fecha_implantacion").isNotNull() & campaign.isNull())
        | ((kind == "CAMPANA") & campaign.isNotNull()),
        "ok_campana": campaign.between(2000, 2100),
        "ok_orden": F.col("fecha_cosecha_estimada") >= F.coalesce("fecha_siembra", "fecha_implantacion"),
        "ok_auto": ~F.col("cosecha_estimada_auto") | F.col("fecha_cosecha_estimada").isNotNull(),
    }


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds one column per rule and ``ok`` for all of them."""
    flagged = df.withColumns({name: _passes(rule) for name, rule in rules.items()})
    return flagged.withColumn("ok", reduce(lambda a, b: a & b, [F.col(n) for n in rules]))


def rejects(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return check(df, rules).filter("NOT ok")


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    flagged = check(df, rules)
    return flagged.agg(
        F.count(F.lit(1)).alias("filas"), *[F.count_if(~F.col(n)).alias(n.replace("ok_", "mal_")) for n in rules]
    )
