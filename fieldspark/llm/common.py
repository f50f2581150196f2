"""Helpers that the operators share: running totals over a global order, connected components, bounded reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.session import cut_lineage, scratch_path


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts the lineage, and later reads take only the columns they need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` wrote, once all that was derived from them is stored or checkpointed itself, and shuffle files."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of what is done go when the driver collects its garbage; with a large heap that may be late, so it is asked to."""
    spark._jvm.System.gc()


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """Adds sums over all earlier rows in ``order`` (the row itself left out), by ``within`` if given.

    Rows are range-partitioned by ``within`` and ``order``, so a hot group spreads over many tasks. Each row sums what lies before it
    in its own partition, and the totals of earlier partitions come from a table of one row per partition and group. Rows that
    are equal in ``order`` follow each other in any order.
    """
    within = within or []
    names = {name: f"_in_{name}" for name in totals}
    keys = [*[F.col(c).asc_nulls_first() for c in within], *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.withColumns({names[n]: c for n, c in totals.items()})
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
    )
    earlier = Window.partitionBy("_part", *within).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    groups = placed.groupBy("_part", *within).agg(*[F.sum(c).alias(c) for c in names.values()])
    parts_before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(
        F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(within)],
        *[F.coalesce(F.sum(c).over(parts_before), F.lit(0)).alias(f"{c}_0") for c in names.values()],
    )
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    own = placed.withColumns({f"{c}_1": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in names.values()})
    return own.join(offsets, same).select(
        *df.columns, *[(F.col(f"{c}_0") + F.col(f"{c}_1")).alias(n) for n, c in names.items()]
    )


#: Copies of each node's smallest neighbour, so that the edges of a hot node are dealt over several tasks.
NODE_SALTS = 4


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: returns (node, component), the smallest reachable node, for all nodes with edges.

    Alternates two contraction steps until nothing changes: larger neighbours of each node move to its smallest neighbour,
    then smaller ones do. Only edges that still connect something are kept, at most one new row per row, and each round is cut
    by a reliable checkpoint. The smallest neighbour is found with partial aggregation and meets the edges salted, so a hot node's edges are
    never one task; after that step a node has one edge for each of its groups, which a window sees.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    salts = F.explode(F.sequence(F.lit(0), F.lit(NODE_SALTS - 1)))
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"), salts.alias("to"))
        dealt = both.where("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(NODE_SALTS)).cast("int"))
        large = dealt.join(lowest, (F.col("a") == F.col("n")) & (F.col("salt") == F.col("to"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
        near = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        pair = F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))).otherwise(F.struct("a", F.col("m").alias("b")))
        # an edge to the smallest one stays, every other one becomes an edge between two smaller nodes
        now = cut_lineage(near.select(pair.alias("e")).select("e.*").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    # every node now hangs on its smallest one
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
