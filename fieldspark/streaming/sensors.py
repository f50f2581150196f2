"""Sensor readings as a stream: a reading is stored once, whenever it comes, and never corrected.

The result does not depend on how files fall into batches: each batch is deduplicated by key and compared with the stored days that it
touches, so nothing rests on a watermark and no late reading is lost. ``late`` counts readings older than ``LATENESS`` days.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldspark.operators.merge import new_rows

SENSOR_KEYS = ["id_sensor", "id_variable", "fecha_hora"]
LATENESS = "15 days"

READINGS_SCHEMA = (
    "id_medicion bigint, id_sensor bigint, id_variable string, fecha_hora timestamp, valor double, otros_datos string"
)


def readings(spark: SparkSession, folder: str, schema: str = READINGS_SCHEMA, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def late(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming readings more than ``LATENESS`` older than the newest stored one: for a report, they are stored all the same."""
    newest = stored.agg(F.max("fecha_hora")).scalar()
    return incoming.filter(F.col("fecha_hora") < newest - F.expr(f"INTERVAL {LATENESS}"))


def sink_once(target: str):
    """Batch writer that adds only keys the table does not hold, so a replayed batch changes nothing.

    Partitions by day: only the days in the batch are read back.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("dia", F.to_date("fecha_hora"))
        order = [F.col("id_medicion")]
        try:
            stored = spark.read.schema(fresh.schema).parquet(target)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = spark.createDataFrame([], fresh.schema)  # first batch: the table does not exist yet
        days = fresh.select("dia").distinct()
        near = stored.join(days, "dia", "left_semi")
        new_rows(near, fresh, SENSOR_KEYS, order).write.mode("append").partitionBy("dia").parquet(target)

    return write


def start(stream: DataFrame, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = (
        stream.writeStream.foreachBatch(sink_once(target))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
