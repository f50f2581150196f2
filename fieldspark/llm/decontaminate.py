"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: every ``window`` consecutive words, or the whole item if it is shorter. The
search moves through a document by blocks of words: a shift table says for the block at hand how far the next possible end of a
window is, and most positions are skipped. Where the shift is zero, the bucket of the block's hash gives the windows that
end so; their first word is compared, then all words, then their bytes. Many places of many documents move at once (numpy).

The tables take about 15 times the bytes of the items' text. A benchmark of more than ``PASS_BYTES`` is cut into blocks: each block in turn is read,
compiled, sent out and searched for in a pass over the documents, and its hits are written, before the next one is read; so
neither the driver nor a task holds more than one block.

Results for odd inputs: a null or empty text has no words; an item without words has no windows; an item whose id is null marks
words but is not counted; repeated items count once, repeated documents each; no items: nothing is hit. Columns of the documents
that clash with the new ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import stored, table
from fieldspark.llm.queries import query
from fieldspark.llm.words import ALNUM, mix64, ngram_hashes, split_words, with_columns

WINDOW = 10
BLOCK = 3
#: Words in a lane: a document is searched at many places at once, each lane up to this many window starts.
LANE = 256
#: Benchmark text that one pass searches for; a larger benchmark is searched in several passes over the documents.
PASS_BYTES = 8 << 20

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_spans", SPAN),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


@dataclass
class Patterns:
    """Windows of one length, ordered by the hash of their last block, with the tables of the search. Words and bytes are those of the items."""

    length: int
    block: int
    hashes: np.ndarray  # of all words of the items
    joined: np.ndarray  # bytes of all words, and where each word begins
    joined_at: np.ndarray
    first: np.ndarray  # first word of each window
    suffix: np.ndarray  # hash of the last block of each window
    item: np.ndarray  # items of the windows one after the other, and where each window's begin
    item_at: np.ndarray
    shift: np.ndarray

    def block_hash(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the ``block`` words that end at each place (the last word's index)."""
        out = np.zeros(len(end), np.uint64)
        for back in range(self.block):
            out = mix64(out + words[end - back])
        return out


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def compile_patterns(items: list[tuple[str | None, str]], window: int = WINDOW, block: int = BLOCK) -> tuple[list[Patterns], list[str | None]]:
    """Search tables, one set for each window length that occurs, and the names of items by number."""
    found = split_words(pa.array([text for _, text in items], pa.large_string()), ALNUM)
    hashes = found.hashes()
    n_words = found.per_row()
    out = []
    for length in np.unique(np.minimum(n_words, window)).tolist():
        if not length:
            continue
        own = np.flatnonzero(np.minimum(n_words, window) == length)
        starts = n_words[own] - length + 1
        owner = np.repeat(own, starts)
        place = np.repeat(found.row_at[own], starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        key = ngram_hashes(hashes, length)[place]
        _, once, same = np.unique(key, return_index=True, return_inverse=True)
        p = Patterns(length, min(block, length), hashes, found.joined, found.joined_at, place[once], *[None] * 4)
        suffix = p.block_hash(hashes, p.first + length - 1)
        order = np.argsort(suffix, kind="stable")
        p.first, p.suffix = p.first[order], suffix[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pairs = np.unique(np.stack([rank[same], owner]), axis=1)
        p.item, p.item_at = pairs[1], np.searchsorted(pairs[0], np.arange(len(order) + 1))
        # a window shares most of its blocks with the next one of its item
        size = 1 << max(12, (8 * len(order)).bit_length())
        p.shift = np.full(size, length - p.block + 1, np.uint8 if length < 256 else np.int32)
        for end in range(p.block - 1, length):  # a block that ends here lets the search move on to the window's end
            np.minimum.at(p.shift, _slot(p.block_hash(hashes, p.first + end), size), length - 1 - end)
        out.append(p)
    return out, [name for name, _ in items]


def occurrences(p: Patterns, words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence in the rows of ``words``."""
    starts = np.maximum(words.per_row() - p.length + 1, 0)  # possible first words in each row
    lanes = -(-starts // LANE)
    row = np.repeat(np.arange(len(lanes)), lanes)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = words.row_at[row] + inside * LANE + p.length - 1
    end = words.row_at[row] + np.minimum((inside + 1) * LANE, starts[row]) + p.length - 1
    candidates = []
    while len(at):
        shift = p.shift[_slot(p.block_hash(hashes, at), len(p.shift))]
        candidates.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        still = at < end
        at, end = at[still], end[still]
    last = np.concatenate(candidates) if candidates else np.zeros(0, np.int64)
    suffix = p.block_hash(hashes, last)
    lo, hi = np.searchsorted(p.suffix, suffix, "left"), np.searchsorted(p.suffix, suffix, "right")
    n = hi - lo
    first = np.repeat(last - p.length + 1, n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    for j in range(p.length):  # the first word, then the others
        same = hashes[first + j] == p.hashes[p.first[window] + j]
        first, window = first[same], window[same]
    return _confirm(p, words, first, window)


def _confirm(p: Patterns, words, first: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose bytes are those of the window, compared together for windows of the same number of bytes."""
    begin, text = words.joined_at[first], p.joined_at[p.first[window]]
    size = p.joined_at[p.first[window] + p.length] - text
    same = words.joined_at[first + p.length] - begin == size
    for n in np.unique(size[same]):
        k = np.flatnonzero(same & (size == n))
        for part in np.array_split(k, -(-len(k) * int(n) // (8 << 20))):
            span = np.arange(n)
            same[part] = (words.joined[begin[part, None] + span] == p.joined[text[part, None] + span]).all(1)
    return first[same], window[same]


def search(tables: tuple[list[Patterns], list[str | None]], column: pa.Array) -> tuple[np.ndarray, list, list]:
    """Of each text: number of words, hit spans (word numbers, end exclusive), names of items with occurring windows."""
    words = split_words(column, ALNUM)
    hashes = words.hashes()
    marks = np.zeros(words.n + 1, np.int64)
    pairs = []
    for p in tables[0]:
        first, window = occurrences(p, words, hashes)
        np.add.at(marks, first, 1)
        np.add.at(marks, first + p.length, -1)
        if len(first):
            row = np.searchsorted(words.row_at, first, "right") - 1
            seen = np.unique(np.stack([row, window]), axis=1)
            pairs += [(int(r), i) for r, w in seen.T for i in p.item[p.item_at[w] : p.item_at[w + 1]]]
    n_rows = len(column)
    spans: list[list] = [[] for _ in range(n_rows)]
    named: list[set] = [set() for _ in range(n_rows)]
    for r, i in pairs:
        if tables[1][i] is not None:
            named[r].add(tables[1][i])
    hit = np.concatenate(([0], (np.cumsum(marks[:-1]) > 0).view(np.int8), [0]))
    edges = np.diff(hit)
    for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        # a stretch of hit words may run over the end of a row into the next
        r = int(np.searchsorted(words.row_at, s, "right")) - 1
        while s < e:
            upto = min(e, words.row_at[r + 1])
            if s < upto:
                spans[r].append((int(s - words.row_at[r]), int(upto - words.row_at[r])))
            s, r = max(s, upto), r + 1
    return words.per_row(), spans, [sorted(x) for x in named]


def _scan(docs: DataFrame, text: str, items: list, window: int, block: int) -> tuple[DataFrame, object]:
    """(``docs`` with the columns of one block of items, the broadcast tables)."""
    tables = docs.sparkSession.sparkContext.broadcast(compile_patterns(items, window, block))

    def scan(column):
        n, spans, named = search(tables.value, column)
        return [pa.array(n, pa.int64()), pa.array(spans, _ARROW_SPAN), pa.array(named, pa.list_(pa.string()))]

    return with_columns(docs, text, FIELDS, scan), tables


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block: int = BLOCK, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """``docs`` with n_words, hit_spans (stretches of words inside occurrences) and hit_items; without a shuffle, if one pass does."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    where = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    read = lambda k: [(r[0], r[1]) for r in items.where(where == k).collect()]  # noqa: E731  about pass_bytes
    if passes == 1:
        return _scan(docs, text, read(0), window, block)[0]
    new = [f.name for f in FIELDS]
    kept = docs.drop(*new)
    rows = stored(kept.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_key")), "documents")
    hits = []
    for k in range(passes):
        found, tables = _scan(rows.select("_key", "_text"), "_text", read(k), window, block)
        hits.append(stored(found.where(F.size("hit_spans") > 0).select("_key", "hit_spans", "hit_items"), f"hits{k}"))
        tables.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.union(more)
    # one row a pass at most for each document
    merged = every.groupBy("_key").agg(
        merged_spans(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items")
    )
    counted, _ = _scan(rows, "_text", [], window, block)
    spans, names = F.coalesce("m.hit_spans", "c.hit_spans").alias("hit_spans"), F.coalesce("m.hit_items", "c.hit_items").alias("hit_items")
    return counted.alias("c").join(merged.alias("m"), "_key", "left").select("c._row.*", "c.n_words", spans, names)


_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged_spans(spans):
    """Union of spans as disjoint spans in order."""

    def add(done, span):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (span["start"] <= last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def n_hit(spans="hit_spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any occurrence, columns as they were."""
    found = decontaminate(docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")), benchmark, "_text")
    return found.where(F.size("hit_items").eqNullSafe(0) & (F.size("hit_spans") == 0)).select("_row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0
), win AS (
  SELECT size, array_to_string(w[s : s + size - 1], ' ') AS phrase, list(DISTINCT CAST(item_id AS VARCHAR)) AS items FROM iw GROUP BY 1, 2
), dw AS (
  SELECT k, size, s, array_to_string(w[s : s + size - 1], ' ') AS phrase
  FROM (SELECT k, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT k, s, dw.size, items FROM dw JOIN win USING (size, phrase)
), words AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + size)) AS p FROM hit) GROUP BY k
), named AS (
  SELECT k, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT k, unnest(items) AS item FROM hit) GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN named USING (k)
"""


@query("op1_decontaminate", ORACLE)
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )

