"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u in (0, 1) from a hash of its id and text and gets the exponential key -ln(u) / quality weight: the smaller the
key, the earlier it is taken. A source whose target exceeds its size is taken whole as often as it fits (complete epochs); the rest
of its target is filled by its documents in key order up to the word budget, the last one if at least half of it fits. What the plan
keeps per source is the number of epochs and the last key taken, so documents are judged row by row afterwards, and
texts are never shuffled. The prefix sums run over a global order in range partitions: a hot source spreads over many tasks.

Rows equal in id and text have the same key. They are dealt one by one, too: the plan says how many of the last key's rows fit, and where that is not
all of them, these rows alone are numbered and the first ones taken.

Odd inputs: null text has size 0 and is never taken; null sources form one source, weighed last; null ids are like any other id; no
rows, no mix. Columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import running_totals, table
from fieldspark.llm.queries import query
from fieldspark.llm.words import ALNUM, LOWER, NONSPACE, text_buffers, with_columns
from fieldspark.session import cut_lineage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words; and how often a source may be repeated at most.
SHARE, MOST = 1.5, 2.0
#: Copies of the small table of sources that a join deals a hot source to.
SALTS = 32

FIELDS = [T.StructField("size", T.LongType()), T.StructField("quality", T.DoubleType())]


def sizes_and_quality(column: pa.Array) -> list:
    """Number of words ``[^\\x20\\x09-\\x0D]+``, and 0.1 to 1 by the share of letters and digits among what is not space."""
    raw, at = text_buffers(column)
    visible = NONSPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begins = visible & (np.concatenate(([True], ~visible[:-1])) | first[:-1]) if len(raw) else visible
    character = (raw & 0xC0) != 0x80  # not a continuation byte: one for each code point

    def per_row(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return upto[at[1:]] - upto[at[:-1]]

    shown = per_row(visible & character)
    letters = per_row(ALNUM[LOWER[raw]] & character)
    return [per_row(begins), 0.1 + 0.9 * (letters / np.maximum(shown, 1))]


def with_keys(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size, quality and mix_key."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    return with_columns(docs.withColumn("_u", u), text, FIELDS, sizes_and_quality).withColumn("mix_key", -F.log("_u") / F.col("quality")).drop("_u")


def _targets(keyed: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: water-filling by weight, capped at ``most`` times the source's size."""
    sources = keyed.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"))
    total, weight_sum = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = F.lit(most) * F.col("source_size") / F.col("weight")  # a source is full when the water stands so high
    filled = running_totals(
        weighed.withColumn("level", level), [F.col("level"), F.col("source").asc_nulls_last()],
        {"full_before": F.lit(most) * F.col("source_size"), "weight_before": F.col("weight")},
    )
    water = (F.lit(share * (total or 0)) - F.col("full_before")) / (F.lit(weight_sum or 1) - F.col("weight_before"))
    open_sources = filled.withColumn("water", water).where("level > water")
    found = open_sources.orderBy("level", F.col("source").asc_nulls_last()).limit(1).select("water").first()
    height = found[0] if found else float("inf")
    return cut_lineage(
        weighed.select("source", "source_size", F.least(F.lit(most) * F.col("source_size"), F.lit(height) * F.col("weight")).alias("target"))
    )


def _order() -> Column:
    return F.struct("mix_key", F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("id"), F.col("size").alias("words"))


def plan_mix(keyed: DataFrame, id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, source_size, target, epochs, last (the last key that the fractional part takes, or null), and how many
    rows have that key (``ties``) and are taken (``fit``)."""
    slim = cut_lineage(keyed.select(F.col(id_col).alias("_id"), "source", "size", "mix_key").withColumn("_r", F.monotonically_increasing_id()))
    targets = _targets(slim, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ordered = running_totals(
        slim.where("size > 0").withColumn("_order", _order()), [F.col("_order"), F.col("_r")], {"before": F.col("size")}, ["source"]
    )
    # a key's rows in a few numbers: which one fits depends on the words before it
    judged = join_sources(ordered, targets).withColumn("_fits", F.col("before") + F.col("size") / 2 <= F.col("rest"))
    by_key = judged.groupBy("source", "_order").agg(F.count("*").alias("ties"), F.count_if("_fits").alias("fit")).where("fit > 0")
    last = by_key.groupBy("source").agg(F.max(F.struct(F.col("_order").alias("last"), "ties", "fit")).alias("_l"))
    last = last.select(F.col("source").alias("_s"), "_l.*")
    return cut_lineage(targets.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "rest"))


def join_sources(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """Adds the columns of the small table by source; salted, so that a hot source is never one task."""
    salted = by_source.withColumnRenamed("source", "_source").withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn("_salt", F.pmod(F.xxhash64("mix_key"), F.lit(SALTS)).cast("int"))
    same = (F.col("_salt") == F.col("_to")) & F.col("source").eqNullSafe(F.col("_source"))
    return dealt.join(salted, same).drop("_salt", "_to", "_source")


def apply_mix(keyed: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds source_size, target and copies: how often the mix holds each document."""
    joined = join_sources(keyed.withColumn("_id", F.col(id_col)), plan)
    some = (F.col("size") > 0) & (_order() == F.col("last")) & (F.col("fit") < F.col("ties"))
    names = [*keyed.columns, "source_size", "target"]

    def taken(rows: DataFrame, extra: Column) -> DataFrame:
        return rows.select(*names, F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(0).alias("copies"))

    whole = F.when((F.col("size") > 0) & (_order() <= F.col("last")), 1).otherwise(0)
    if plan.where("fit < ties").isEmpty():  # a row per source
        return taken(joined, whole)
    tied = joined.where(F.coalesce(some, F.lit(False))).withColumn("_r", F.monotonically_increasing_id())
    numbered = running_totals(tied, [F.col("_r")], {"_nth": F.lit(1)}, ["source"])
    rest = joined.where(~F.coalesce(some, F.lit(False)))
    return taken(rest, whole).union(taken(numbered, F.when(F.col("_nth") < F.col("fit"), 1).otherwise(0)))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the documents' columns, each row as often as the mix takes it."""
    keyed = with_keys(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source"))
    taken = apply_mix(keyed, plan_mix(keyed, **options)).where("copies > 0")
    return taken.withColumn("_nth", F.explode(F.sequence(F.lit(1), "copies"))).select("_row.*")


ORACLE = r"""
WITH k AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS shown,
         length(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest
  FROM documents
), d AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(digest, 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / (0.1::DOUBLE + 0.9::DOUBLE * (letters::DOUBLE / greatest(shown, 1)::DOUBLE)) AS mix_key
  FROM k
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS level,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0.0::DOUBLE) AS full_before, coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS weight_before
  FROM s
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT (1.5::DOUBLE * total - full_before) / (weights - weight_before) AS water FROM f
  WHERE level > (1.5::DOUBLE * total - full_before) / (weights - weight_before) ORDER BY level, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT water FROM h), 'infinity'::DOUBLE) * weight) AS target FROM s
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
), o AS (
  SELECT d.*, source_size, target, epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, coalesce(CAST(doc_id AS VARCHAR), ''), size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) END
            AS BIGINT) AS taken
FROM o
"""


@query("op2_mix_sources", ORACLE)
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    keyed = cut_lineage(
        with_keys(table(spark, folder, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "size", "mix_key")
    )
    mixed = apply_mix(keyed, plan_mix(keyed))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
