"""N-gram Jaccard join: documents whose sets of word 5-grams (shingles) have a Jaccard similarity of at least 0.8, and their groups.

Only similarities that pass 100 * intersection >= 80 * union count, and none of them is missed:

1. Documents with the same set form one class; a class is known by a 64-bit sum over its shingles, and only classes go on.
2. Extended prefixes. A class with n shingles needs o = ceil(0.8 n) common ones. Of its shingles in hash order it shows the first
   n - o + k: two linked classes have at least k of the shown ones in common (k grows with n, the smaller of both counts). Shingles
   that only one class shows are dropped; a class with fewer common ones than any partner asks for has no partner. Text that many
   documents repeat, such as a passage, thus drops out without a pair being made.
3. Combinations. The classes left are read in full. Of the s shingles that a class has in common with others, the s - o + 1 rarest hold
   at least one that it shares with any partner. These index the class: shingles whose bucket holds few groups alone, frequent ones
   (more than FREQUENT groups) together with each next one in the order, as two or more are needed. What a class has for itself
   bounds from below how much a pair differs; most pairs fail that without a look at their texts.
4. Groups without all pairs. In every index bucket each class is verified against a leader (of each part of a bucket: no leader
   has more than PART partners); verified links make groups. Then only buckets that still hold several groups are looked at, with new
   leaders, and at last all pairs of classes of different groups. Pairs inside a group need no look: groups are all that is asked.
5. Verification. Parity bitmaps of whole sets bound the difference of a pair; those that pass have their common shingles counted from
   both texts.

Nothing is capped or sampled. Odd inputs: null and empty texts have no shingles, link with nothing and are their own group; a text of
one to four words has one shingle, the whole sequence; repeated rows and equal ids are rows of their own, a group is named by its
smallest id (null if it has none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import components, discard, free_shuffles, stored, table
from fieldspark.llm.queries import query
from fieldspark.llm.words import NONSPACE, mix64, ngram_hashes, pieces, split_words, with_columns

N = 5
PERCENT = 80
#: Shingles shown beyond the plain prefix: EXTRA + n / EXTRA_SHARE, at most all.
EXTRA, EXTRA_SHARE = 26, 20
#: Classes from which a shingle counts as frequent and is indexed together with another one.
FREQUENT = 512
#: Shingles at the front of a class's order by which a pair is told to be the business of another bucket.
HEAD = 16
#: Bits of a class's parity bitmap: two bitmaps differ in no more bits than their sets in shingles.
PARITY_BITS = 1024
#: Partners of one leader at most, and rounds with leaders before all remaining pairs are taken.
PART, ROUNDS = 1024, 1
#: Copies of rows of the class table, so that a class of very many copies is dealt over several tasks.
SALTS = 8
#: Bits of the fixed-size filter (2 MB) that spares a pass over the texts the rows of other classes.
FILTER_BITS = 1 << 24
BUCKET_BITS = 8 * 4096
#: Turns in which the shown shingles are counted.
TURNS = 2


def needed(n, percent=PERCENT):
    """ceil(percent / 100 * n), for arrays and columns alike."""
    return (n * percent + 99) // 100


def extra(n):
    return np.minimum(needed(n), EXTRA + n // EXTRA_SHARE)


def extra_column(n: Column) -> Column:
    """The k that every partner of a class with n shingles shows at least: that of the smallest partner."""
    smallest = F.ceil(n * PERCENT / 100).cast("long")
    return F.least(F.ceil(smallest * PERCENT / 100).cast("long"), F.lit(EXTRA) + F.floor(smallest / EXTRA_SHARE))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in hash order, one text after the other, and where each begins."""
    words = split_words(column, NONSPACE)
    hashes = words.hashes()
    grams = ngram_hashes(hashes, N)
    sets = []
    for lo, hi in zip(words.row_at[:-1], words.row_at[1:], strict=True):
        if hi - lo >= N:
            sets.append(np.unique(grams[lo : hi - N + 1]))
        elif hi > lo:
            sets.append(ngram_hashes(hashes[lo:hi], hi - lo))
        else:
            sets.append(np.zeros(0, np.uint64))
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), at


def class_ids(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal numbers."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(values), dtype=np.uint64)))
    return mix64(upto[at[1:]] - upto[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def _shown(column: pa.Array) -> list:
    """Of each text: number of shingles, class, and the extended prefix."""
    values, at = shingle_sets(column)
    n = np.diff(at)
    take = np.where(n > 0, n - needed(n) + extra(n), 0)
    upto = np.concatenate(([0], np.cumsum(take)))
    first = np.arange(upto[-1]) - np.repeat(upto[:-1], take) + np.repeat(at[:-1], take)
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values[first].view(np.int64)))
    return [n, class_ids(values, at), lists]


SHOWN = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]


def counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds how many rows have the same key. Rows travel once; a hot key's rows are spilled, not held."""
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(key)))


def possible_nodes(rows: DataFrame) -> DataFrame:
    """node of the classes that show as many common shingles as any partner asks for.

    ``rows`` (stored) and the shuffle of its shingles are the largest tables: shingles are counted in turns, each turn's shuffle goes
    before the next, and ``rows`` goes after the last.
    """
    tokens = rows.where("n_shingles > 3").select("node", F.col("n_shingles").alias("n"), F.explode("tokens").alias("token"))
    parts = []
    for turn in range(TURNS):
        part = counted(tokens.where(F.pmod("token", F.lit(TURNS)) == turn), "token", "freq").where("freq > 1")
        parts.append(stored(part.select("token", "node", "n").distinct(), "common"))
        free_shuffles(rows.sparkSession)
    discard(rows)
    common = reduce(DataFrame.union, parts)
    left = counted(common, "node", "have").where(F.col("have") >= extra_column(F.col("n"))).select("token", "node", "n")
    # counted again among the classes that are left: the shingles of passages are gone with most of their documents
    shared = counted(left, "token", "freq").where("freq > 1").groupBy("node", "n").count()
    possible = stored(shared.where(F.col("count") >= extra_column(F.col("n"))).select("node"), "possible")
    discard(*parts)
    return possible


def common_shingles(texts: DataFrame) -> DataFrame:
    """token, node, n, own, place, short: the rarest common shingles of each class, from its whole set.

    ``own`` counts its shingles that no other class has; classes with more than a partner allows are gone. Places up to ``short`` hold
    the first shingle that a class has in common with any partner, the place after it the second.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                values, at = shingle_sets(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(at)), lists], ["node", "n", "tokens"])

    sets = texts.select("node", "text").mapInArrow(run, "node long, n long, tokens array<long>")
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    of_class = Window.partitionBy("node")
    least = F.ceil(F.col("n") * PERCENT / 100).cast("long")
    ranked = counted(tokens, "token", "freq").where("freq > 1").withColumns(
        {"place": F.row_number().over(of_class.orderBy("freq", "token")), "have": F.count("*").over(of_class)}
    )
    ranked = ranked.withColumns({"own": F.col("n") - F.col("have"), "short": F.col("have") - least + 1})
    return stored(ranked.where("short > 0 and place <= short + 1").select("token", "node", "n", "own", "place", "short"), "ranked")


def parity(values: np.ndarray) -> list[int]:
    """Bit k tells whether an odd number of shingles falls on it."""
    odd = np.bincount((values % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def texts_of(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """node, n, bits, text: one text of each class in ``nodes``, its set's size and parity bitmap. A fixed-size bit filter keeps most other texts out of the shuffle."""
    bits = nodes.select(F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("p"))
    rows = bits.groupBy(F.floor(F.col("p") / BUCKET_BITS).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(p % {BUCKET_BITS})").alias("bits"))
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, part in rows.collect():  # at most FILTER_BITS / BUCKET_BITS rows of 4 KB
        filled[bucket * BUCKET_BITS // 8 :][: len(part)] = np.frombuffer(part, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches):
        filled = shared.value
        for batch in batches:
            for part in pieces(batch, text):
                values, at = shingle_sets(part.column(text))
                ids = class_ids(values, at)
                bit = ids & (FILTER_BITS - 1)
                hit = (filled[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                _, once = np.unique(ids, return_index=True)
                keep = np.zeros(len(ids), bool)
                keep[once] = (hit[once] == 1) & (np.diff(at)[once] > 0)
                rows = np.flatnonzero(keep)
                bits = [parity(values[at[r] : at[r + 1]]) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(np.diff(at)[rows]), pa.array(bits, pa.list_(pa.int64())), part.column(text).take(pa.array(rows))],
                    ["node", "n", "bits", "text"],
                )

    found = docs.select(text).mapInArrow(run, "node long, n long, bits array<long>, text string")
    one = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first(F.struct("n", "bits", "text")).alias("r"))
    return stored(one.select("node", "r.*"), "texts")


def _near_bits(bits_a: str, bits_b: str, n_a: str, n_b: str) -> Column:
    """No pair that links differs in more bits than its sets may differ in shingles."""
    differ = sum(F.bit_count(F.get(bits_a, F.lit(k)).bitwiseXOR(F.get(bits_b, F.lit(k)))) for k in range(PARITY_BITS // 64))
    return differ * (100 + PERCENT) <= (F.col(n_a) + F.col(n_b)) * (100 - PERCENT)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link: by their bitmaps first, then from the texts of both."""
    marks = lambda x: texts.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    pairs = pairs.join(marks("a"), "a").join(marks("b"), "b").where(_near_bits("bits_a", "bits_b", "n_a", "n_b")).select("a", "b")
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                one, one_at = shingle_sets(part.column("text_a"))
                two, two_at = shingle_sets(part.column("text_b"))
                n_one, n_two = np.diff(one_at), np.diff(two_at)
                common = np.array(
                    [
                        len(np.intersect1d(one[i:j], two[k:m], assume_unique=True))
                        for i, j, k, m in zip(one_at[:-1], one_at[1:], two_at[:-1], two_at[1:], strict=True)
                    ],
                    np.int64,
                )
                links = 100 * common >= PERCENT * (n_one + n_two - common)
                yield part.select(["a", "b"]).filter(pa.array(links))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _may_link(n_a, own_a, n_b, own_b) -> Column:
    """Length filter, and own shingles: a pair may differ in (100 - p) / (100 + p) of both counts."""
    similar = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    return similar & ((F.col(own_a) + F.col(own_b)) * (100 + PERCENT) <= (F.col(n_a) + F.col(n_b)) * (100 - PERCENT))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def leader_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """Each class with the leader of its part of each bucket, and the leaders of parts with the leader of the bucket.

    ``buckets``: key, node, n, own, group, size (rows of the bucket). Leaders differ by turn; pairs of one group are left out.
    """
    lead = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "own", "group")
    parts = buckets.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART)))
    leaders = parts.groupBy("key", "part").agg(F.min(lead).alias("lead"))
    heads = leaders.groupBy("key").agg(F.min("lead").alias("head"))
    members = parts.join(leaders, ["key", "part"]).select("node", "n", "own", "group", "lead")
    between = leaders.join(heads, "key").select("lead.node", "lead.n", "lead.own", "lead.group", F.col("head").alias("lead"))
    both = members.union(between).where((F.col("group") != F.col("lead.group")) & _may_link("n", "own", "lead.n", "lead.own"))
    return _pairs(both.select(F.col("node").alias("a"), F.col("lead.node").alias("b")))


def open_buckets(keyed: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The buckets that hold several groups: key, node, n, own, group, size."""
    if groups is None:
        named = keyed.withColumn("group", F.col("node"))
    else:
        named = keyed.join(groups.withColumnRenamed("component", "_g"), "node", "left").withColumn("group", F.coalesce("_g", "node")).drop("_g")
    several = named.groupBy("key").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi"), F.count("*").alias("size"))
    return named.join(several.where("_lo <> _hi").select("key", "size"), "key")


def all_pairs(buckets: DataFrame, heads: DataFrame) -> DataFrame:
    """All pairs of classes of different groups in a bucket that their counts allow.

    ``buckets``: key, token, second (of a combination, else null), place (of the last one), node, n, own, group. A pair meets in many buckets.
    If the heads of both have common shingles, only the bucket of the first of those (or the first two) counts. Else, a bucket counts only if it may be
    the first common one: all shingles before it then belong to one side, and they and the own ones must fit into the difference.
    Parity bitmaps bound the difference of whole sets; few pairs that do not link pass them.
    """
    rows = buckets.join(heads, "node")
    side = lambda x: rows.select("key", "token", "second", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "own", "group", "place", "head", "bits")])
    both = F.array_intersect("head_a", "head_b")
    here = (F.get(both, F.lit(0)) == F.col("token")) & (F.col("second").isNull() | (F.size(both) < 2) | (F.get(both, F.lit(1)) == F.col("second")))
    differ = (F.col("own_a") + F.col("own_b") + F.col("place_a") + F.col("place_b") - 4) * (100 + PERCENT) <= (F.col("n_a") + F.col("n_b")) * (100 - PERCENT)
    met = side("a").join(side("b").drop("token", "second"), "key").where(
        (F.col("node_a") < F.col("node_b"))
        & (F.col("group_a") != F.col("group_b"))
        & _may_link("n_a", "own_a", "n_b", "own_b")
        & _near_bits("bits_a", "bits_b", "n_a", "n_b")
        & F.when(F.arrays_overlap("head_a", "head_b"), here).otherwise(differ)
    )
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def combined(ranked: DataFrame, frequent: DataFrame) -> DataFrame:
    """Frequent shingles of the prefix, each with every later one up to one place further: key, node, n, own."""
    first = ranked.where("place <= short").join(frequent, "token").select("node", F.col("token").alias("first"), F.col("place").alias("p"))
    pairs = first.join(ranked, "node").where("place > p")
    return pairs.select(F.xxhash64("first", "token").alias("key"), F.col("first").alias("token"), F.col("token").alias("second"), "place", "node", "n", "own")


def class_groups(docs: DataFrame, text: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, component), rows without tokens): classes that link directly or through others, only those with links.

    The shown shingles are the largest table; it and all others go as soon as what follows from them is stored. Each step is a short query
    of its own: the driver holds the plans, stages and tasks of a query until it ends, so one query for many steps fills its memory.
    """
    slim = stored(rows.drop("tokens"), "rows")
    possible = possible_nodes(rows)
    texts = texts_of(docs, text, possible)
    discard(possible)
    ranked = common_shingles(texts)
    free_shuffles(docs.sparkSession)
    keyed = ranked.where("place <= short").select(F.col("token").alias("key"), "token", F.lit(None).cast("long").alias("second"), "place", "node", "n", "own")
    buckets = stored(open_buckets(keyed, None), "buckets")
    scratch = [texts, ranked]
    links = seen = groups = None
    for turn in range(ROUNDS):
        pairs = leader_pairs(buckets, turn)
        pairs = stored(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        found = stored(verified(pairs, texts), "links")
        free_shuffles(docs.sparkSession)
        seen = pairs if seen is None else seen.union(pairs)
        links = found if links is None else links.union(found)
        groups = components(links)
        done, buckets = buckets, stored(open_buckets(keyed, groups), "buckets")
        scratch += [pairs, found]
        discard(done)
    front = ranked.where(F.col("place") <= F.least(F.lit(HEAD), F.col("short")))
    heads = front.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("head"))
    heads = stored(heads.join(texts.select("node", "bits"), "node"), "heads")
    frequent = stored(buckets.groupBy("token").agg(F.count_distinct("group").alias("k")).where(F.col("k") > FREQUENT).select("token"), "frequent")
    rare = stored(all_pairs(buckets.join(frequent, "token", "left_anti"), heads).join(seen, ["a", "b"], "left_anti"), "pairs")
    scratch.append(rare)
    pairs = rare
    if not frequent.isEmpty():
        joint = stored(open_buckets(combined(ranked, frequent), groups), "buckets")
        often = stored(all_pairs(joint, heads).join(seen, ["a", "b"], "left_anti"), "pairs")
        discard(joint)
        scratch.append(often)
        pairs = rare.union(often).distinct()
    discard(buckets, heads, frequent)
    found = stored(verified(pairs, texts), "links")
    if not found.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
    discard(found, *scratch)
    return groups, slim


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id of its group)."""
    marked = with_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("_text")), "_text", SHOWN, _shown)
    groups, rows = class_groups(docs, text, stored(marked.drop("_text"), "shown"))
    groups = groups.withColumnRenamed("node", "_n")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    named = classes.join(groups, F.col("node") == F.col("_n"), "left").withColumn("group", F.coalesce("component", "node"))
    smallest = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    special = named.where("copies > 1 or component is not null").join(smallest, "group").select("node", "component_id")
    dealt = special.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = own.join(dealt, ["node", "_salt"], "left")
    alone = F.col("n_shingles") == 0
    return joined.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of each group stays: the one with the smallest id, one without an id only if all are. Rows without words stay.

    Rows are told apart by two hashes over all their columns, so an id may have several texts; rows equal in all columns stay once.
    """
    row, key = [F.col(c) for c in docs.columns], ["_k1", "_k2"]
    empty = [c.isNull() for c in row]
    keyed = docs.withColumns({"_k1": F.xxhash64(*row, *empty), "_k2": F.xxhash64(*empty, *reversed(row))})
    shown = with_columns(keyed.select("doc_id", *key, F.col("text").alias("_text")), "_text", SHOWN, _shown)
    groups, rows = class_groups(docs, "text", stored(shown.drop("_text").withColumn("no_id", F.col("doc_id").isNull()), "shown"))
    groups = groups.withColumnRenamed("node", "_n")
    place = F.struct("no_id", "doc_id", *key)
    kinds = rows.where("n_shingles > 0").groupBy("node", "no_id", "doc_id", *key).agg(F.count("*").alias("copies"))
    classes = kinds.groupBy("node").agg(F.min(place).alias("first"), F.count("*").alias("kinds"))
    named = classes.join(groups, F.col("node") == F.col("_n"), "left").withColumn("group", F.coalesce("component", "node"))
    smallest = named.groupBy("group").agg(F.min("first").alias("stays"), F.sum("kinds").alias("of_group"))
    special = stored(named.join(smallest, "group").where("of_group > 1").select("node", "stays"), "special")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    own = kinds.withColumn("_salt", F.pmod(F.xxhash64("_k1"), F.lit(SALTS)).cast("int"))
    told = own.join(special.withColumn("_salt", salts), ["node", "_salt"], "left")
    keep = F.col("stays").isNull() | place.eqNullSafe(F.col("stays"))
    marks = stored(told.select(*key, "copies", keep.alias("keep")).where("not keep or copies > 1"), "marks")
    discard(special)
    dealt = marks.withColumn("_salt", salts)
    salted = keyed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    kept = salted.join(dealt, [*key, "_salt"], "left_anti").select(*docs.columns)
    if marks.where("keep").isEmpty():
        return kept
    repeated = salted.join(dealt.where("keep"), [*key, "_salt"], "left_semi")
    return kept.union(repeated.groupBy(*key).agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN hash(array_to_string(w, ' ')) ELSE hash(array_to_string(w[s : s + 4], ' ')) END AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM g AS a JOIN g AS b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n AS x ON x.doc_id = a.doc_id JOIN n AS y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(x.n) + min(y.n) - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON links.a = reach.other
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c ON c.doc_id = d.doc_id
"""


@query("op6_ngram_jaccard", ORACLE)
def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents"))
