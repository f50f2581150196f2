"""Embedding near-duplicates by a random-projection tree forest with spill.

Vectors of a label enter ``trees`` trees. Every node splits near the median of a random projection, where few vectors lie, one direction per tree
and level; vectors near the cut go to both sides (spill), so close pairs seldom part. Nodes of up to ``LEAF`` vectors are leaves, and so are
nodes that a split no longer shrinks. Inside a leaf all pairs are compared in double precision, block by block; a leaf larger than ``LEAF``
(vectors too close to part) is dealt to tasks as pairs of blocks, so no task holds it whole. A pair that shares several leaves counts
in the first of them only; so link counts add up without any list of pairs, and each leaf passes on a few links per vector that
connect what is connected there. Connected components of those are the groups.

Equal vectors of a label are one point with a count. The projections are computed once; levels move only these numbers. Trees grow level
by level with Spark aggregations (approximate medians), on all rows, not on a sample. Recall is measured against brute force in the tests.

Odd inputs: a null label, a null, zero, empty or non-finite vector links with nothing and is its own group; vectors of different lengths
under one label are compared only with those of their length; repeated vec_ids are rows of their own and a group is named by the smallest
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import components, stored, table
from fieldspark.llm.queries import query

COSINE = 0.93
TREES = 6
LEAF = 512
#: Half width of the spill zone, in standard deviations that the projections of a pair at the threshold differ by.
SPILL = 0.6
#: A split must leave each child at most this share of the node, else the node becomes a leaf.
SHRINK = 0.9
MAX_LEVELS = 40
SEED = 20240607


def direction(dim: int, tree: int, level: int) -> np.ndarray:
    v = np.random.default_rng([SEED, dim, tree, level]).standard_normal(dim)
    return v / np.linalg.norm(v)


def _units(vectors: list) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(c: Column) -> Column:
    """Neither null, empty nor zero, all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0), F.lit(False))


def points(vectors: DataFrame) -> DataFrame:
    """point, label, dim, vec, copies, first_id: distinct usable vectors of each label."""
    v = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))  # one zero, not two
    rows = vectors.where(F.col("label").isNotNull() & usable(F.col("embedding")))
    same = rows.select("vec_id", "label", v.alias("vec")).groupBy("label", "vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    return stored(same.withColumns({"dim": F.size("vec"), "point": F.monotonically_increasing_id()}), "points")


def project(pts: DataFrame, trees: int, levels: int) -> DataFrame:
    """point, label, dim, tree, proj: the projections of each point for all levels of each tree."""

    def run(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x = _units(part["vec"].tolist())
                for tree in range(trees):
                    d = np.stack([direction(dim, tree, level) for level in range(levels)], 1)
                    out = part[["point", "label", "dim"]].copy()
                    out["tree"] = tree
                    out["proj"] = list(x @ d)
                    yield out

    label_type = pts.schema["label"].dataType.simpleString()
    return pts.select("point", "label", "dim", "vec").mapInPandas(run, f"point long, label {label_type}, dim int, tree int, proj array<double>")


def sparse_cut(c: Column) -> Column:
    """A value near the median with few points around it: the middle of the widest gap between neighbouring percentiles."""
    marks = F.percentile_approx(c, [k / 100 for k in range(30, 71, 5)], 400)
    gaps = lambda m: F.zip_with(F.slice(m, 1, 8), F.slice(m, 2, 8), lambda a, b: F.struct((b - a).alias("gap"), ((a + b) / 2).alias("at")))
    return F.array_max(gaps(marks))["at"]


def grow(pts: DataFrame, trees: int = TREES, leaf: int = LEAF, cosine: float = COSINE) -> DataFrame:
    """leaf, point, size: all leaves of all trees (size: points of the leaf)."""
    most = pts.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log2(max(2, most / leaf)) * 2)))
    node = F.xxhash64("tree", "label", "dim")
    now = project(pts, trees, levels).withColumn("node", node)
    done = None
    for level in range(levels + 1):
        now = stored(now, f"level{level}")
        sizes = now.groupBy("node", "tree").agg(F.count("*").alias("size"), *([] if level == levels else [sparse_cut(F.element_at("proj", level + 1)).alias("cut")]))
        small = (F.col("size") <= leaf) | F.lit(level == levels)
        placed = now.join(sizes.drop("tree"), "node")
        leaves = placed.where(small).select("node", "point", "size")
        done = leaves if done is None else done.union(leaves)
        if level == levels:
            break
        margin = F.lit(SPILL * math.sqrt(2 * (1 - cosine))) / F.sqrt("dim")
        off = F.element_at("proj", level + 1) - F.col("cut")
        big = placed.where(~small).withColumns({"lo": off <= margin, "hi": off > -margin})
        # a node that does not shrink stays whole
        fate = big.groupBy("node").agg((F.greatest(F.sum(F.col("lo").cast("long")), F.sum(F.col("hi").cast("long"))) > SHRINK * F.max("size")).alias("whole"))
        fated = stored(big.join(fate, "node"), f"split{level}")
        done = done.union(fated.where("whole").select("node", "point", "size"))
        split = fated.where("not whole")
        sides = F.filter(F.array(F.when(F.col("lo"), F.lit(0)), F.when(F.col("hi"), F.lit(1))), lambda s: s.isNotNull())
        split = split.withColumn("side", F.explode(sides))
        now = split.select("point", "label", "dim", "tree", "proj", F.xxhash64("node", F.lit(level), "side").alias("node"))
        if split.isEmpty():
            break
    return stored(done.withColumnRenamed("node", "leaf"), "leaves")


def compare(pts: DataFrame, leaves: DataFrame, leaf: int = LEAF, cosine: float = COSINE) -> DataFrame:
    """a, b, n: b is null and n the number of linked vectors found for a in one block pair; or (a, b) is a link that connects."""
    lists = leaves.groupBy("point").agg(F.array_sort(F.collect_list("leaf")).alias("in_leaves"))  # a few leaves per tree
    rows = leaves.join(lists, "point").join(pts.select("point", "vec", "copies"), "point")
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    mine = F.pmod(F.xxhash64("point"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = rows.withColumn("mine", mine).withColumn("other", other).withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def run(key, pdf):
        this, i, j = key
        x = _units(pdf["vec"].tolist())
        ids, copies, mine = pdf["point"].to_numpy(), pdf["copies"].to_numpy(), pdf["mine"].to_numpy()
        near = (x @ x.T) >= cosine
        np.fill_diagonal(near, False)
        if i != j:
            near &= mine[:, None] != mine[None, :]
        if not near.any():
            return pd.DataFrame({"a": [], "b": [], "n": []})
        # pairs that share an earlier leaf were counted there
        lists = [[x for x in leaves if x < this] for leaves in pdf["in_leaves"]]
        number = {x: k for k, x in enumerate(sorted({x for y in lists for x in y}))}
        new = near
        if number:
            member = np.zeros((len(ids), len(number)), np.float32)
            for row, y in enumerate(lists):
                member[row, [number[x] for x in y]] = 1
            new = near & ((member @ member.T) == 0)
        counts = new @ copies
        lowest = np.arange(len(ids))
        while True:  # smallest index that each point reaches
            nearest = np.minimum(lowest, np.where(near, lowest[None, :], len(ids)).min(1))
            nearest = nearest[nearest]
            if (nearest == lowest).all():
                break
            lowest = nearest
        has, tied = counts > 0, lowest != np.arange(len(ids))
        return pd.concat(
            [
                pd.DataFrame({"a": ids[has], "b": pd.array([None] * int(has.sum()), "Int64"), "n": counts[has]}),
                pd.DataFrame({"a": ids[tied], "b": pd.array(ids[lowest[tied]], "Int64"), "n": 0}),
            ]
        )

    return dealt.select("leaf", "i", "j", "point", "vec", "copies", "mine", "in_leaves").groupBy("leaf", "i", "j").applyInPandas(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, trees: int = TREES, leaf: int = LEAF, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    pts = points(vectors)
    found = stored(compare(pts, grow(pts, trees, leaf, cosine), leaf, cosine), "found")
    groups = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "_p")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "_a")
    named = (
        pts.join(groups, F.col("point") == F.col("_p"), "left")
        .join(counts, F.col("point") == F.col("_a"), "left")
        .withColumn("group", F.coalesce("component", "point"))
    )
    smallest = named.groupBy("group").agg(F.min("first_id").alias("component_id"))
    special = named.where("copies > 1 or others > 0").join(smallest, "group")
    special = special.select("label", "vec", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id")
    v = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = vectors.select("vec_id", "label", F.when(usable(F.col("embedding")), v).alias("vec"))
    # a point of very many copies is dealt over several tasks
    dealt = special.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(8)).cast("int")).join(dealt, ["label", "vec", "_salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


@query("op8_embedding_near_dup")
def op8_embedding_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))
