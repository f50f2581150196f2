"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of token pairs.

Tokenizer A is a byte-level vocabulary (``byte_bpe_50k.json``), B a piece model (``piece_bpe_32k.model``). A gets a space and the text, B the
text, to which it adds the space itself, so both spell the same bytes. Per block of about ``BLOCK_BYTES`` of text (or one longer text), in Arrow:

* token lists are flattened with parent indices, and a segmented cumulative sum of token sizes gives the byte where each token ends;
* one full outer Acero join of both sides on (document, end) has a row for every place where some token ends. Where both sides end, a group
  is cut; backward-filled, each row is one pair of overlapping tokens, since two tokens overlap in one stretch between neighbouring ends;
* ``group_by`` counts the pairs of each document, and then the documents of each pair in the block.

Spark adds up the blocks' partial counts, so a pair that occurs in every document is one row per block. The totals go back along
the same (block, place in the block's dictionary) rows and meet each block as one array, as long as its own dictionary.

Odd inputs: texts that are null, empty, not valid UTF-8, or that a tokenizer does not spell exactly (B turns U+2581 into a space) have no
tokens: zeros and an empty digest. Special tokens' strings are plain text. Repeated rows and ids, and null ids, are documents of their
own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.llm.common import stored, table
from fieldspark.llm.queries import query
from fieldspark.llm.words import pieces, text_buffers

#: Folder of the vocabulary files, on every machine.
TOKENIZERS = "/opt/tokenizers"
BLOCK_BYTES = 2 << 20
#: A pair as one number: A's id times this, plus B's id.
PAIR_BITS = 31
PAIR = 1 << PAIR_BITS
#: How the byte-level vocabulary splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Vocabulary:
    encode: object  # list of texts -> list of integer sequences
    token: pa.Array  # bytes of each id
    size: np.ndarray
    decimal: pa.Array  # each id as text


def _vocabulary(encode, tokens: list[bytes]) -> Vocabulary:
    token = pa.array(tokens, pa.large_binary())
    return Vocabulary(encode, token, np.array([len(t) for t in tokens], np.int64), pa.array([str(i) for i in range(len(tokens))], pa.large_string()))


def byte_level_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself if it shows, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """The byte-level vocabulary. Ids are merge ranks, so ``tiktoken`` gives the ids that ``tokenizers`` gives, several times faster."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = byte_level_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
    for name, i in vocab.items():
        tokens[i] = name.encode() if name in special else bytes(alphabet[c] for c in name)
    ranks = {tokens[i]: i for name, i in vocab.items() if name not in special}
    coder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _vocabulary(lambda texts: [coder.encode_to_numpy(" " + t, disallowed_special=()) for t in texts], tokens)


@lru_cache(maxsize=2)
def piece_level(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [
        bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(model.id_to_piece(list(range(model.get_piece_size()))))
    ]
    return _vocabulary(lambda texts: model.encode(texts, num_threads=1), tokens)


def vocabularies(folder: str) -> tuple[Vocabulary, Vocabulary]:
    return byte_level(f"{folder}/byte_bpe_50k.json"), piece_level(f"{folder}/piece_bpe_32k.model")


def _lists(sequences: list) -> pa.ListArray:
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    flat = np.concatenate([np.asarray(s, np.int32) for s in sequences]) if len(sequences) else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), flat)


def _spelled(lists: pa.ListArray, vocabulary: Vocabulary, texts: list[bytes]) -> np.ndarray:
    """Which lists spell a space and their text."""
    token = vocabulary.token.take(lists.flatten())
    _, at, data = token.buffers()
    raw = memoryview(data).cast("B") if data is not None else memoryview(b"")
    at = np.frombuffer(at, np.int64, len(token) + 1, token.offset * 8)[np.asarray(lists.offsets)]
    return np.array([raw[i:j] == b" " + t for i, j, t in zip(at[:-1], at[1:], texts)], bool)


def _ends(lists: pa.ListArray, vocabulary: Vocabulary, name: str) -> pa.Table:
    """doc, end, and the token's place: a cumulative sum of sizes, begun anew in each list."""
    parents = pc.list_parent_indices(lists)
    total = np.concatenate(([0], np.cumsum(vocabulary.size[np.asarray(lists.flatten())])))
    begin = total[np.asarray(lists.offsets)[:-1]]
    end = total[1:] - begin[np.asarray(parents)]
    return pa.table({"doc": parents, "end": end, name: pa.array(np.arange(len(end), dtype=np.int64))})


@dataclass
class Aligned:
    """Documents are rows of the chunk; links and tokens come in their order."""

    kept: np.ndarray  # rows that have tokens
    a: pa.ListArray
    b: pa.ListArray
    doc: np.ndarray  # of each link, as a place in kept
    end: np.ndarray
    pair: np.ndarray
    a_group: np.ndarray  # number of the group of each A token, over all documents
    b_group: np.ndarray
    cut_doc: np.ndarray  # of each group
    cut_end: np.ndarray


def align(column: pa.Array, a: Vocabulary, b: Vocabulary) -> Aligned:
    raw, at = text_buffers(column)
    everything = raw.tobytes()
    whole = [everything[i:j] for i, j in zip(at[:-1], at[1:])]
    rows = np.flatnonzero(np.diff(at) > 0)
    texts = [whole[r].decode("utf-8", "replace") for r in rows]
    a_ids, b_ids = _lists(a.encode(texts)), _lists(b.encode(texts) if texts else [])
    good = _spelled(a_ids, a, [whole[r] for r in rows]) & _spelled(b_ids, b, [whole[r] for r in rows]) if texts else np.zeros(0, bool)
    a_ids, b_ids = a_ids.filter(pa.array(good)), b_ids.filter(pa.array(good))
    both = _ends(a_ids, a, "a").join(_ends(b_ids, b, "b"), keys=["doc", "end"], join_type="full outer", use_threads=False)
    both = both.take(pc.sort_indices(both, sort_keys=[("doc", "ascending"), ("end", "ascending")])).combine_chunks()
    in_a, in_b = (both[c].is_valid().to_numpy().astype(bool) for c in "ab")
    cut = in_a & in_b
    group = np.cumsum(cut) - cut
    # the token of the other side that covers a place is the next one to end
    a_of, b_of = (pc.fill_null_backward(both[c]).to_numpy() for c in "ab")
    pair = np.asarray(a_ids.flatten(), np.int64)[a_of] * PAIR + np.asarray(b_ids.flatten(), np.int64)[b_of]
    doc, end = both["doc"].to_numpy(), both["end"].to_numpy()
    return Aligned(rows[good], a_ids, b_ids, doc, end, pair, group[in_a], group[in_b], doc[cut], end[cut])


def _grouped(values: pa.Array, groups: np.ndarray, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(groups, np.arange(n + 1)), pa.int32()), values)


def group_texts(x: Aligned, a: Vocabulary, b: Vocabulary) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each kept document."""
    n = len(x.cut_doc)
    comma, bar, semicolon = (pa.scalar(c, pa.large_string()) for c in ",|;")
    sides = [
        pc.binary_join(_grouped(v.decimal.take(ids.flatten()), groups, n), comma)
        for v, ids, groups in ((a, x.a, x.a_group), (b, x.b, x.b_group))
    ]
    return pc.binary_join(_grouped(pc.binary_join_element_wise(*sides, bar), x.cut_doc, len(x.kept)), semicolon)


def _spread(n: int, kept: np.ndarray, values) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[kept] = values
    return out


def _list_column(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32()), pa.array(values, kind))


def _blocks(docs: DataFrame, id_col: str, text: str, folder: str) -> DataFrame:
    """One row per block: its documents' figures, each document's pairs as places in the block's dictionary, and the dictionary with counts."""
    id_type = docs.schema[id_col].dataType
    doc_type = T.StructType(
        [T.StructField("id", id_type), *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
         T.StructField("groups_sha256", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    )
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(doc_type)),
         T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("docs_with", T.ArrayType(T.IntegerType()))]
    )

    def run(batches):
        a, b = vocabularies(folder)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                n = part.num_rows
                x = align(part.column("text"), a, b)
                m = len(x.kept)
                links = pa.table({"doc": x.doc, "pair": x.pair})
                per_doc = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
                per_doc = per_doc.sort_by([("doc", "ascending"), ("pair", "ascending")])
                counts = per_doc.group_by("pair", use_threads=False).aggregate([([], "count_all")])
                place = pc.index_in(per_doc["pair"], value_set=counts["pair"].combine_chunks()).to_numpy()
                digest = np.full(n, "", object)
                digest[x.kept] = [hashlib.sha256(s.as_py().encode()).hexdigest() for s in group_texts(x, a, b)]
                held = _spread(n, x.kept, np.bincount(per_doc["doc"].to_numpy(), minlength=m))
                figures = [
                    _spread(n, x.kept, v)
                    for v in (pc.list_value_length(x.a), pc.list_value_length(x.b), np.bincount(x.cut_doc, minlength=m), np.bincount(x.doc, minlength=m))
                ]
                documents = pa.StructArray.from_arrays(
                    [part.column("id"), *map(pa.array, figures), pa.array(digest, pa.string()), _list_column(place, held, pa.int32()),
                     _list_column(per_doc["count_all"].to_numpy(), held, pa.int32())],
                    [f.name for f in doc_type],
                )
                whole = np.array([n])
                dictionary = [_list_column(counts["pair"].to_numpy(), np.array([len(counts)]), pa.int64()), _list_column(counts["count_all"].to_numpy(), np.array([len(counts)]), pa.int32())]
                rows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], whole)), pa.int32()), documents)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), rows, *dictionary], schema.names)
                block += 1

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, pair, count (documents), best (no pair of this A token has a higher count)."""
    partial = blocks.select(F.explode(F.arrays_zip("pairs", "docs_with")).alias("p"))
    counts = partial.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs_with").alias("count"))
    a = F.shiftright("pair", PAIR_BITS)  # at most one row per B token and A token: bounded by B's vocabulary
    return counts.withColumn("a", a).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _finish(batches):
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column("docs").slice(i, 1).flatten()
            counts = np.asarray(batch.column("counts").slice(i, 1).flatten(), np.int64)
            best = np.asarray(batch.column("bests").slice(i, 1).flatten().cast(pa.int8()), np.int64)
            at, times = docs.field("at"), docs.field("times")
            doc, place, n = np.asarray(pc.list_parent_indices(at)), np.asarray(at.flatten()), np.asarray(times.flatten(), np.int64)

            def total(values, doc=doc, rows=len(docs)):
                upto = np.concatenate(([0], np.cumsum(values)))
                return upto[np.searchsorted(doc, np.arange(rows), "right")] - upto[np.searchsorted(doc, np.arange(rows))]

            sums = [total(best[place] * n), total(counts[place] * n)]
            yield pa.RecordBatch.from_arrays([*[docs.field(c) for c in names], *map(pa.array, sums)], [*names, "n_best", "count_sum"])


def align_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    blocks = stored(_blocks(docs, id_col, text, folder), "token-blocks")
    places = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    counted = places.join(pair_counts(blocks).select("pair", "count", "best"), "pair")
    # as many as the block's dictionary has pairs
    back = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("p"))
    back = back.select("block", F.col("p.count").alias("counts"), F.col("p.best").alias("bests"))
    none = [F.coalesce("counts", F.array().cast("array<bigint>")).alias("counts"), F.coalesce("bests", F.array().cast("array<boolean>")).alias("bests")]
    whole = blocks.select("block", "docs").join(back, "block", "left").select("docs", *none)
    long = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return whole.mapInArrow(_finish, f"id {docs.schema[id_col].dataType.simpleString()}, {long}").withColumnRenamed("id", id_col)


def token_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """The alignment itself: one row per group with the id, its number in the document, its byte range (the space is byte 0) and both sides' ids."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        a, b = vocabularies(folder)
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                x = align(part.column("text"), a, b)
                n = len(x.cut_doc)
                first = np.searchsorted(x.cut_doc, x.cut_doc)
                begin = np.where(np.arange(n) == first, 0, np.concatenate(([0], x.cut_end[:-1])) if n else 0)
                ids = part.column("id").take(pa.array(x.kept[x.cut_doc]))
                sides = [_grouped(v.flatten(), g, n).cast(pa.list_(pa.int32())) for v, g in ((x.a, x.a_group), (x.b, x.b_group))]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (np.arange(n) - first, begin, x.cut_end)), *sides], ["id", "nth", "begin", "end", "a", "b"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"id {id_type}, nth long, begin long, end long, a array<int>, b array<int>").withColumnRenamed("id", id_col)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_documents(table(spark, folder, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
