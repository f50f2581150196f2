"""Readers and writers of text, CSV, GeoJSON and snapshots."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldspark.functions.numbers import fixed
from fieldspark.session import number_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str | StructType | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with header and doubled quotes; a byte-order mark on the first header is removed.

    Spark does not read windows-1252: such files are read as ISO-8859-1, which differs only in 0x80–0x9F, and mapped.
    """
    western = encoding.lower() in ("windows-1252", "cp1252")
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", "ISO-8859-1" if western else encoding)
        .option("quote", '"')
        .option("escape", '"')
    )
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("\ufeff").strip('"'))
    if western:
        df = df.select(*[F.translate(c, *_WESTERN).alias(c) if k == "string" else F.col(f"`{c}`") for c, k in df.dtypes])
    return df


def _western_controls() -> tuple[str, str]:
    codes = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
    return "".join(map(chr, codes)), bytes(codes).decode("cp1252")


_WESTERN = _western_controls()


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Whitespace-separated numbers without header."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(
        *[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)]
    )


def read_geojson(spark: SparkSession, path: str, properties: str, multi_line: bool = True) -> DataFrame:
    """One row per feature: typed properties and point coordinates.

    ``properties`` lists ``name:type`` pairs. ``multi_line`` reads one document per file, else one per line.
    """
    geometry = "struct<type:string,coordinates:array<double>>"
    feature = f"struct<type:string,properties:struct<{properties}>,geometry:{geometry}>"
    docs = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", multi_line).json(path)
    at = lambda i: F.get("f.geometry.coordinates", F.lit(i))
    return docs.select(F.explode("features").alias("f")).select("f.properties.*", at(0).alias("x"), at(1).alias("y"))


def latest_snapshot_path(files: DataFrame) -> DataFrame:
    """The file with the newest modification time; the later name on ties. ``files``: ``path, modificationTime``."""
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


MANIFEST = "_snapshot.json"


def _hadoop(spark: SparkSession, path: str):
    """(file system, path object) of a path on whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _data_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path below the folder, length, modification time) of its data files; names that begin with _ or . are not data."""
    fs, root = _hadoop(spark, folder)
    prefix = fs.makeQualified(root).toString().rstrip("/") + "/"
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString().removeprefix(prefix)
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.append((name, f.getLen(), f.getModificationTime()))
    return sorted(found)


def write_snapshot(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """Writes a parquet snapshot and, last of all, its manifest: time, number of rows, and every file with its length.

    A snapshot without a manifest, or without one of its files, was not finished; readers pass over it.
    """
    spark = df.sparkSession
    counted = Observation("snapshot")
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.partitionBy(*(partition_by or [])).parquet(folder)
    files = _data_files(spark, folder)
    manifest = {"written_ms": max((t for *_, t in files), default=0), "rows": counted.get["rows"], "files": [[name, size] for name, size, _ in files]}
    fs, where = _hadoop(spark, f"{folder}/{MANIFEST}")
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest of a snapshot, or null if it has none, it is damaged, or a file is missing or of another length."""
    fs, where = _hadoop(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        manifest = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except (ValueError, Py4JJavaError):  # not JSON, or a checksum that does not hold
        return None
    finally:
        stream.close()
    there = {name: size for name, size, _ in _data_files(spark, folder)}
    return manifest if all(there.get(name) == size for name, size in manifest["files"]) else None


def latest_snapshot_folder(spark: SparkSession, pattern: str) -> str | None:
    """The newest complete snapshot among the folders that match; where none has a manifest, the folder that holds the newest file.

    The later name wins ties. Only names, lengths and times of files are read.
    """
    fs, where = _hadoop(spark, pattern)
    folders = sorted(f.getPath().toString() for f in (fs.globStatus(where) or []) if f.isDirectory())
    complete = [(m["written_ms"], f) for f in folders if (m := read_manifest(spark, f)) is not None]
    if complete:
        return max(complete)[1]
    plain = [(max(t for *_, t in files), f) for f in folders if (files := _data_files(spark, f))]
    return max(plain)[1] if plain else None


def read_latest_snapshot(spark: SparkSession, pattern: str) -> DataFrame:
    """All rows of the newest parquet snapshot among the folders that match the pattern, partition columns included."""
    folder = latest_snapshot_folder(spark, pattern)
    if folder is None:
        raise FileNotFoundError(f"no snapshot matches {pattern}")
    return spark.read.parquet(folder)


def keep_newest_versions(snapshots: DataFrame, n: int = 2, group: list[str] | None = None) -> DataFrame:
    """Rows of the ``n`` newest versions (per dataset when ``group`` is given)."""
    keys = group or []
    versions = snapshots.select(*keys, "version").distinct()
    if not keys:
        return snapshots.join(versions.orderBy(F.desc("version")).limit(n), "version", "left_semi")
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("version"))
    newest = versions.withColumn("_rank", F.dense_rank().over(w)).filter(F.col("_rank") <= n)
    return snapshots.join(newest, [*keys, "version"], "left_semi")


def write_feature_csv(df: DataFrame, path: str, order: list[Column], number: str = "Rf", digits: int = 3) -> DataFrame:
    """Sorted, numbered, rounded CSV with a byte-order mark on the first header; returns the written rows.

    ``order`` must end with a unique key. Parts keep the global order by file name.
    """
    rounded = df.select(*[fixed(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
    numbered = number_rows(rounded, order, number)
    out = numbered.select(number, *[c for c in numbered.columns if c != number])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        out.repartitionByRange(parts, number)
        .sortWithinPartitions(number)
        .withColumnRenamed(number, "\ufeff" + number)
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
    return out


def replace_table(df: DataFrame, path: str) -> None:
    """The writer splits the rows over files by itself."""
    df.write.mode("overwrite").parquet(path)


def atomic_swap(df: DataFrame, root: str, version: str, orphan: Column) -> str:
    """Writes a new snapshot folder, checks it, and only then points ``CURRENT`` to it.

    Readers follow the pointer and so see either the old or the new snapshot. Raises when any row is an orphan.
    """
    spark = df.sparkSession
    target = f"{root}/{version}"
    df.write.mode("overwrite").parquet(target)
    orphans = spark.read.parquet(target).filter(orphan).count()
    if orphans:
        raise ValueError(f"{orphans} orphan rows: the snapshot is not published")
    pointer = spark.createDataFrame([(version,)], StructType([StructField("version", StringType())]))
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/CURRENT")
    return target


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/CURRENT").first()["version"]  # one row
    return spark.read.parquet(f"{root}/{version}")


def concat_training_days(days: list[DataFrame], order: list[Column]) -> DataFrame:
    """Union of daily feature files without their row number, renumbered."""
    out = days[0].drop("Rf")
    for d in days[1:]:
        out = out.unionByName(d.drop("Rf"), allowMissingColumns=True)
    return number_rows(out, order, "Rf")


def geojson_features(df: DataFrame, geometry: Column, properties: list[Column]) -> DataFrame:
    """One GeoJSON Feature per row as text."""
    feature = F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")
    )
    return df.select(F.to_json(feature).alias("value"))
