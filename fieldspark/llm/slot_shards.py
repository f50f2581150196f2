"""Sharding through fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots, which never change. Bytes are added up per slot, and a small versioned map says
which shard holds which slot. Balancing, or adding a shard, edits the map: as few slots as needed move, and only their records. The map
has one row per slot, so it is bounded by ``SLOTS`` whatever the data, and the driver may edit it.

Records hash by id, text checksum and size. Rows that are equal in all of these and together outweigh a slot (there can be at most
``SLOTS`` such groups) are dealt over all slots one by one; they are interchangeable. Law: ``bytes``.

A later run reads the newest version of the map, measures, edits and writes the next one, so what is already placed stays where it can.

Odd inputs: a null text has 8 bytes; null ids hash like any other; repeated rows are dealt like others; an empty table gives an empty
result. Columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import running_totals, table
from fieldspark.llm.queries import query
from fieldspark.session import cut_lineage, scratch_path

SLOTS = 4096
SHARDS = 24
#: Bytes of a record besides its text.
OVERHEAD = 8
#: A shard may differ from the mean by this share before slots move.
TOLERANCE = 0.002

MAP = "version int, slot int, shard int"


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds size (bytes) and text_crc32."""
    filled = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {"size": (F.octet_length(filled) + OVERHEAD).cast("long"), "text_crc32": F.crc32(filled.cast("binary")).cast("long")}
    )


def heavy_rows(records: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Groups of equal rows that outweigh a slot: at most ``slots`` of them."""
    total = records.agg(F.sum("size")).first()[0] or 0
    groups = records.groupBy(F.col(id_col).alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"))
    heavy = groups.agg(F.sum("size").alias("_b"), F.count("*").alias("_n")).where((F.col("_b") > total // slots) & (F.col("_n") > 1))
    return cut_lineage(heavy.select("_id", "_crc", "_size"))


def with_slots(records: DataFrame, heavy: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Adds vslot. ``heavy`` has at most ``slots`` rows, so it may be broadcast."""
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_crc32") == F.col("_crc")) & (F.col("size") == F.col("_size"))
    dealt = records.withColumn("_row", F.monotonically_increasing_id()).join(F.broadcast(heavy), same, "left")
    salt = F.when(F.col("_crc").isNotNull(), F.col("_row")).otherwise(F.lit(-1))
    vslot = F.pmod(F.xxhash64(id_col, "text_crc32", "size", salt), F.lit(slots)).cast("int")
    return dealt.withColumn("vslot", vslot).drop("_row", "_id", "_crc", "_size")


def slot_loads(slotted: DataFrame) -> dict[int, int]:
    """Bytes per slot: one row per slot."""
    return {r[0]: r[1] for r in slotted.groupBy("vslot").agg(F.sum("size")).collect()}


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    return {s: s % shards for s in range(slots)}


def rebalance(owner: dict[int, int], loads: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> dict[int, int]:
    """A new map for ``shards`` shards. Full shards give away slots, the emptiest take them; other slots stay. The old map stays while its
    fullest and emptiest shard differ by less than an average slot, or if a new one is no better."""

    def spread(of: dict[int, int]) -> int:
        full = dict.fromkeys(range(shards), 0)
        for slot, k in of.items():
            full[k] += loads.get(slot, 0)
        return max(full.values()) - min(full.values())

    before = dict(owner)
    mean = sum(loads.values()) / shards
    fits = max(owner.values()) < shards and set(owner.values()) == set(range(shards))
    if fits and spread(owner) <= max(tolerance * mean, mean * shards / len(owner)):
        return before
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(shards)}
    pool = []
    for slot, shard in owner.items():
        (held[shard] if shard < shards else pool).append((loads.get(slot, 0), slot))
    full = {k: sum(b for b, _ in v) for k, v in held.items()}
    for k, v in held.items():
        for load, slot in sorted(v, reverse=True):
            if load and full[k] - load >= mean * (1 - tolerance):
                full[k] -= load
                v.remove((load, slot))
                pool.append((load, slot))
    heap = [(b, k) for k, b in full.items()]
    heapq.heapify(heap)
    for load, slot in sorted(pool, reverse=True):
        b, k = heapq.heappop(heap)
        held[k].append((load, slot))
        full[k] = b + load
        heapq.heappush(heap, (full[k], k))
    for _ in range(len(owner)):  # last, single moves or swaps between the fullest and the emptiest
        hi, lo = max(full, key=full.get), min(full, key=full.get)
        gap = full[hi] - full[lo]
        if gap <= tolerance * mean or not held[hi]:
            break
        give = min(held[hi], key=lambda x: abs(x[0] - gap / 2))
        if not 0 < give[0] < gap:
            break
        held[hi].remove(give)
        held[lo].append(give)
        full[hi] -= give[0]
        full[lo] += give[0]
    after = {slot: k for k, v in held.items() for _, slot in v}
    return before if fits and spread(before) <= spread(after) else after


def store_map(spark: SparkSession, path: str, version: int, owner: dict[int, int]) -> None:
    """Writes one version; earlier ones stay. A version cannot be written twice."""
    rows = [(version, slot, shard) for slot, shard in sorted(owner.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{path}/v{version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/v{version:06d}")


def newest_version(spark: SparkSession, path: str) -> int | None:
    """The newest version that was written to the end, by names alone."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []
    return max((int(f.getPath().getParent().getName()[1:]) for f in found), default=None)


def plan_shards(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(heavy rows, current map). The newest stored map is edited by the bytes measured now, and the result is the next version.

    Without a stored map, version 1 deals slots in turn. A map that needs no edit stays the newest. ``path`` keeps the versions from run to run.
    """
    spark = records.sparkSession
    heavy = heavy_rows(records, slots=slots)
    path = path or scratch_path(spark, "slot-map")
    version = newest_version(spark, path)
    if version is None:
        version = 1
        store_map(spark, path, version, first_map(shards, slots))
    owner = {r["slot"]: r["shard"] for r in load_map(spark, path, version).collect()}  # a row per slot
    edited = rebalance(owner, slot_loads(with_slots(records, heavy, slots=slots)), shards)
    if edited != owner:
        version += 1
        store_map(spark, path, version, edited)
    return heavy, load_map(spark, path, version)


def assign(records: DataFrame, heavy: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds vslot and shard: the map has one row per slot, so it is broadcast."""
    owner = F.broadcast(slot_map.select(F.col("slot").alias("vslot"), "shard"))
    return with_slots(records, heavy, slots=slots).join(owner, "vslot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """The documents with a column shard; with ``path``, by the map stored there, edited as needed."""
    kept = docs.drop("shard")
    slim = cut_lineage(measured(kept.select("doc_id", "text")).select("doc_id", "size", "text_crc32"))
    heavy, slot_map = plan_shards(slim, shards, path=path)
    rows = measured(kept.select("doc_id", "text", F.struct("*").alias("_all")))
    return assign(rows, heavy, slot_map).select("_all.*", "shard")


@query("op9_slot_shards")
def op9_slot_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    records = cut_lineage(measured(docs).select("doc_id", "size", "text_crc32"))
    placed = assign(records, *plan_shards(records))
    order = [F.col("vslot"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    numbered = running_totals(placed, order, {"slot": F.lit(1)}, ["shard"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
