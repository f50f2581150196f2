"""Line dedup: repeated runs of lines are found by a suffix order over line sequences, and later copies are deleted.

Texts become sequences of line ids (blank lines left out). Ranks of suffixes come from distributed prefix doubling: the rank by one line gives
the rank by two, four, ... lines, each round numbering the distinct pairs of ranks in order. Suffixes whose beginning is unique leave
at once, so rounds work on what is repeated only. A run counts when it holds at least ``MIN_WORDS`` words: each position begins
a shortest such stretch, w lines long. Two overlapping ranks of 2^k lines cover it, so positions that are equal in w and both ranks
have a common prefix of w lines: they are neighbours in the suffix order and make one longest-common-prefix interval.

A position that is not the first of its interval (by id, then line) begins a later copy. Its longest common prefix with any earlier place
is found from the lines after the stretch: its own interval is split by one, two, ... of them as long as another place goes on
alike, and the deepest interval in which it is still not the first gives the length. Those lines are few, as the stretch of the next position takes
over where it ends. The whole common prefix is deleted, so a line goes exactly if it lies in a run of ``MIN_WORDS`` words or more that stands
earlier elsewhere (overlapping itself, too).

Lines are equal if they are the same but for the case of ASCII letters. Odd inputs: null texts stay null and have no lines; rows equal in
id and text are one document, each with its result; null ids come first; blank lines stay; an empty table gives an empty result; columns
that clash with the new ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import stored, table
from fieldspark.llm.queries import query
from fieldspark.llm.words import NONSPACE, mix64, pieces, split_words
from fieldspark.session import number_rows

MIN_WORDS = 50
#: Copies of small tables that hot intervals and repeated rows are dealt over.
SALTS = 8
SPACE = " \t\n\x0b\x0c\r"
IN_LINE = np.arange(256) != 10


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """id, k1, k2 (of the document), seq, line (its id), w, tail: one row per line that is not blank.

    ``tail`` has a hash of the first, the first two, ... lines after the stretch of w lines, up to where the stretch of the next line ends.
    """
    id_type = docs.schema["_id"].dataType

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                lines, words = split_words(part.column("_text"), IN_LINE), split_words(part.column("_text"), NONSPACE)
                n = np.bincount(np.searchsorted(lines.start, words.start, "right") - 1, minlength=lines.n) if lines.n else np.zeros(0, np.int64)
                shown = np.flatnonzero(n > 0)
                row = lines.rows()[shown]
                first = np.searchsorted(row, np.arange(part.num_rows))
                upto = np.searchsorted(row, np.arange(part.num_rows), "right")
                total = np.concatenate(([0], np.cumsum(n[shown])))
                end = np.searchsorted(total, total[:-1] + min_words)
                w = np.where(end <= upto[row], end - np.arange(len(shown)), 0)
                code = mix64(lines.hashes()[shown] + lines.size[shown].astype(np.uint64)) if len(shown) else np.zeros(0, np.uint64)
                tails = tail_hashes(code, w, upto[row])
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c).take(take) for c in ("_id", "_k1", "_k2")],
                        pa.array(np.arange(len(shown)) - first[row]), pa.array(code.view(np.int64)), pa.array(w), tails,
                    ],
                    ["id", "k1", "k2", "seq", "line", "w", "tail"],
                )

    schema = T.StructType(
        [T.StructField("id", id_type)] + [T.StructField(c, T.LongType()) for c in ("k1", "k2", "seq", "line", "w")]
        + [T.StructField("tail", T.ArrayType(T.LongType()))]
    )
    return docs.select("_id", "_k1", "_k2", "_text").mapInArrow(run, schema)


def tail_hashes(code: np.ndarray, w: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """For each line a list: hashes of the first 1, 2, ... lines after its stretch, up to where the stretch of the next line ends.

    ``end``: where the document of a line ends. Lines without a stretch (w = 0) have none.
    """
    at = np.arange(len(code))
    upto = np.where(w > 0, at + w, 0)
    following = np.concatenate((upto[1:], [0])) if len(code) else upto
    same = at + 1 < end
    limit = np.where(same & (following > 0), following - 1, end)
    n = np.where(w > 0, np.maximum(0, limit - upto), 0)
    begin = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint64)
    h = np.zeros(len(code), np.uint64)
    for j in range(int(n.max()) if len(n) else 0):  # fewer lines than a stretch has words
        here = np.flatnonzero(n > j)
        h[here] = mix64(h[here] * np.uint64(0x9E3779B97F4A7C15) + code[upto[here] + j] + np.uint64(1))
        out[begin[here] + j] = h[here]
    return pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(out)])) if len(code) else [0], pa.int32()), pa.array(out.view(np.int64)))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces ``keys`` by rank: the place of their values among all that occur at least twice; other rows go."""
    often = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)
    return rows.join(number_rows(often, [F.col(k) for k in keys], "rank"), keys).drop(*keys)


def intervals(lines: DataFrame) -> DataFrame:
    """id, k1, k2, seq, w, r1, r2 of all positions whose shortest stretch is repeated: equal (w, r1, r2) make an interval."""
    document = ["k1", "k2"]
    now = stored(ranked(lines.drop("tail"), ["line"]), "rank0")
    most = now.agg(F.max("w")).first()[0] or 0
    done, size = None, 1
    while size <= most:
        # stretches of size up to 2 size - 1 lines are covered by two ranks of this round
        here = now.where((F.col("w") >= size) & (F.col("w") < 2 * size))
        last = now.select("k1", "k2", F.col("seq").alias("at"), F.col("rank").alias("r2"))
        covered = here.withColumn("at", F.col("seq") + F.col("w") - size).join(last, [*document, "at"])
        covered = covered.select("id", "k1", "k2", "seq", "w", F.col("rank").alias("r1"), "r2")
        done = covered if done is None else done.union(covered)
        following = Window.partitionBy(*document).orderBy("seq").rangeBetween(size, size)
        if 2 * size <= most:
            pairs = now.withColumn("next", F.min("rank").over(following)).where("next is not null")
            now = stored(ranked(pairs.withColumnRenamed("rank", "this"), ["this", "next"]), f"rank{size}")
        size *= 2
    return done if done is not None else now.withColumns({"r1": F.col("rank"), "r2": F.col("rank")}).drop("rank").limit(0)


def not_first(found: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``found`` (key, id, k1, k2, seq) that are not the first place of their key. Hot keys are dealt over several tasks."""
    place = F.struct("id", "k1", "k2", "seq")
    firsts = found.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    salted = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = found.withColumn("_salt", F.pmod(F.xxhash64("k1", "seq"), F.lit(SALTS)).cast("int")).join(salted, [*key, "_salt"])
    return copies.where(~place.eqNullSafe(F.col("first"))).drop("first", "_salt")


def later_copies(found: DataFrame, lines: DataFrame) -> DataFrame:
    """k1, k2, runs: what of each document stands earlier elsewhere, as (seq, number of lines)."""
    found = stored(found, "intervals")
    tails = lines.where(F.size("tail") > 0).select("k1", "k2", "seq", "tail").join(found, ["k1", "k2", "seq"])
    deeper = tails.select("id", "k1", "k2", "seq", "w", "r1", "r2", F.posexplode("tail").alias("j", "h"))
    longer = not_first(deeper, ["w", "r1", "r2", "j", "h"]).select("k1", "k2", "seq", (F.col("w") + F.col("j") + 1).alias("w"))
    both = not_first(found, ["w", "r1", "r2"]).select("k1", "k2", "seq", "w").union(longer)
    return both.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("seq", "w"))).alias("runs"))  # of one document


def _rewrite(text: str | None, runs: list | None) -> tuple[str | None, int, int]:
    """(text without the runs, lines, deleted lines)."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0
    kept, seq, at, upto = [], 0, 0, 0
    for line in lines:
        if not line.strip(SPACE):
            kept.append(line)
            continue
        while at < len(runs) and runs[at]["seq"] <= seq:
            upto = max(upto, runs[at]["seq"] + runs[at]["w"])
            at += 1
        if seq >= upto:
            kept.append(line)
        seq += 1
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def delete_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the text rewritten and columns n_lines and n_removed."""
    rows = docs.drop("n_lines", "n_removed")
    names = rows.columns
    key = [F.col(id_col).cast("string"), F.col(text)]
    keyed = rows.withColumns({"_k1": F.xxhash64(*key), "_k2": F.xxhash64(F.lit(1), *reversed(key))})
    slim = keyed.select(F.col(id_col).alias("_id"), "_k1", "_k2", F.col(text).alias("_text"))
    lines = stored(lines_of(slim, min_words).dropDuplicates(["k1", "k2", "seq"]), "lines")
    runs = later_copies(intervals(lines), lines).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    runs = runs.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    salted = keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(runs, ["_k1", "_k2", "_salt"], "left").select(*names, "runs")
    fields = [*rows.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                done = [_rewrite(t, r) for t, r in zip(part.column(text).to_pylist(), part.column("runs").to_pylist(), strict=True)]
                new, n, gone = zip(*done, strict=True) if done else ((), (), ())
                columns = [pa.array(new, part.column(text).type) if c == text else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))


ORACLE = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, n, line, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
), s AS (
  SELECT *, row_number() OVER w AS seq, sum(words) OVER w AS total FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), f AS (
  SELECT s.doc_id, s.seq, min(e.seq) AS upto FROM s JOIN s AS e ON e.doc_id = s.doc_id AND e.total >= s.total - s.words + 50
  GROUP BY s.doc_id, s.seq
), g AS (
  SELECT f.doc_id, f.seq, f.upto, md5(string_agg(s.low, chr(10) ORDER BY s.seq)) AS run
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.seq BETWEEN f.seq AND f.upto GROUP BY f.doc_id, f.seq, f.upto
), r(doc_id, seq, upto, run) AS (
  -- every repeated run of 50 words or more, longer and longer
  SELECT doc_id, seq, upto, run FROM (SELECT *, count(*) OVER (PARTITION BY run) AS c FROM g) WHERE c > 1
  UNION ALL
  SELECT doc_id, seq, upto, run FROM (
    SELECT r.doc_id, r.seq, s.seq AS upto, md5(r.run || s.low) AS run, count(*) OVER (PARTITION BY md5(r.run || s.low)) AS c
    FROM r JOIN s ON s.doc_id = r.doc_id AND s.seq = r.upto + 1) WHERE c > 1
), k AS (
  SELECT doc_id, seq, max(upto) AS upto FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, seq) AS nth FROM r) WHERE nth > 1 GROUP BY doc_id, seq
), gone AS (
  SELECT DISTINCT s.doc_id, s.n FROM s JOIN k ON k.doc_id = s.doc_id AND s.seq BETWEEN k.seq AND k.upto
)
SELECT d.doc_id, CAST(count(l.n) AS BIGINT) AS n_lines, CAST(count(gone.n) AS BIGINT) AS n_removed,
       CAST(length(coalesce(string_agg(CASE WHEN gone.n IS NULL THEN line END, chr(10) ORDER BY l.n), '')) AS BIGINT) AS kept_chars,
       sha256(coalesce(string_agg(CASE WHEN gone.n IS NULL THEN line END, chr(10) ORDER BY l.n), '')) AS kept_sha256
FROM documents AS d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.n = l.n
GROUP BY d.doc_id
"""


@query("op3_line_runs", ORACLE)
def op3_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    done = delete_repeated_runs(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
