"""Per-crop linear forecast of reference evapotranspiration from lag features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fieldspark.functions.numbers import fixed
from fieldspark.operators.interpolation import LAG_PREFIX, lag_names

MIN_ROWS = 6
DAYS_OUT = 4


def _inputs(newest: int) -> list[str]:
    """33 input columns: eleven days of each variable, the last one ``newest`` days before the run."""
    return [
        f"{p}_t-{d}" if d else f"{p}_t" for p in LAG_PREFIX.values() for d in range(newest + 10, newest - 1, -1)
    ]


TRAIN_INPUTS = _inputs(DAYS_OUT)
TRAIN_TARGETS = ["Ev_t-3", "Ev_t-2", "Ev_t-1", "Ev_t"]
PREDICT_INPUTS = _inputs(0)
OUTPUTS = [f"ET_{k}" for k in range(DAYS_OUT)]
_WIDTH = len(TRAIN_INPUTS) + 1


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and crop: row count and the sums of products of inputs and targets."""
    held: dict[str, tuple[int, np.ndarray]] = {}
    for pdf in batches:
        for crop, rows in pdf.groupby("Cl"):
            x = np.column_stack([np.ones(len(rows)), rows[TRAIN_INPUTS].to_numpy(float).round(3)])
            full = x.T @ np.column_stack([x, rows[TRAIN_TARGETS].to_numpy(float).round(3)])
            n, total = held.get(crop, (0, 0.0))
            held[crop] = (n + len(rows), total + full)
    out = [(crop, n, total.ravel().tolist()) for crop, (n, total) in held.items()]
    yield pd.DataFrame(out, columns=["Cl", "n", "sums"])


def train_per_crop(features: DataFrame) -> DataFrame:
    """Coefficients per crop with at least six complete rows: ``Cl, n, coef`` (34 × 4, input-major).

    The rows of a crop never meet in one task: each task adds up its products, the sums are added by position, and one
    34 × 38 system per crop is solved.
    """
    needed = TRAIN_INPUTS + TRAIN_TARGETS
    complete = features.select("Cl", *[F.col(f"`{c}`") for c in needed]).dropna()
    partial = complete.mapInPandas(_partial_sums, "Cl string, n long, sums array<double>")
    counts = partial.groupBy("Cl").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_ROWS)
    sums = (
        partial.select("Cl", F.posexplode("sums").alias("pos", "v"))
        .groupBy("Cl", "pos")
        .agg(F.sum("v").alias("v"))
        .groupBy("Cl")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("sums"))
    )

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(column: pd.Series) -> pd.Series:
        def one(flat) -> list[float]:
            m = np.asarray(flat, float).reshape(_WIDTH, _WIDTH + DAYS_OUT)
            gram = m[:, :_WIDTH]
            ridge = 1e-6 * np.trace(gram) / _WIDTH
            return np.linalg.solve(gram + ridge * np.eye(_WIDTH), m[:, _WIDTH:]).ravel().tolist()

        return column.map(one)

    return counts.join(sums, "Cl").select("Cl", "n", solve("sums").alias("coef"))


def predict_per_crop(features: DataFrame, models: DataFrame, keep: list[str]) -> DataFrame:
    """Four forecast days per row with complete inputs and a model of its crop; column arithmetic only."""
    complete = features.dropna(subset=PREDICT_INPUTS)
    inputs = F.array(F.lit(1.0), *[fixed(F.col(f"`{c}`"), 3) for c in PREDICT_INPUTS])
    joined = complete.join(models.select("Cl", "coef"), "Cl").withColumn("_x", inputs)

    def output(k: int):
        terms = F.transform(F.col("_x"), lambda v, i: v * F.get("coef", i * DAYS_OUT + k))
        return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)

    return joined.select("Cl", *keep, *[output(k).alias(name) for k, name in enumerate(OUTPUTS)])


def prediction_outcomes(features: DataFrame, models: DataFrame) -> DataFrame:
    """Crops and rows with a model, without one, and with a model but no complete row."""
    ready = F.lit(True)
    for c in PREDICT_INPUTS:
        ready = ready & F.col(f"`{c}`").isNotNull()
    per_crop = features.groupBy("Cl").agg(F.count(F.lit(1)).alias("n"), F.count_if(ready).alias("n_ready"))
    outcome = (
        F.when(F.col("coef").isNull(), "sin_modelo").when(F.col("n_ready") == 0, "sin_filas").otherwise("ok")
    )
    return (
        per_crop.join(models.select("Cl", "coef"), "Cl", "left")
        .groupBy(outcome.alias("resultado"))
        .agg(F.count(F.lit(1)).alias("cultivos"), F.sum("n").alias("filas"))
    )
