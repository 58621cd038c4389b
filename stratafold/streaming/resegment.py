"""Event-time buckets from a stream, closed by a watermark, and segmentation of the closed part.

The stream only appends closed buckets (late events beyond the watermark are dropped by Spark), so the sink is a plain
sequence table. `resegment` reruns the kernel on it; boundaries in the tail may move between runs as buckets arrive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segment
from ..operators.lineage import shared_dir
from ..sources.sequences import complete, indexed


def closed_buckets(stream: DataFrame, key: str, at: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts per key and event-time window; append mode emits a window once the watermark has passed it."""
    s = stream.select(F.col(key).alias("seq_id"), F.col(at).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return s.groupBy("seq_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("y")).select("seq_id", F.col("w.start").alias("bucket"), F.col("y").cast("double").alias("y"))


def run_to_table(buckets: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is available, then stops; a restart goes on from the checkpoint."""
    q = buckets.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def resegment(spark: SparkSession, path: str, name: str = "poisson", k_max: int = 4, tail: int | None = None) -> DataFrame:
    """Segments of the closed buckets at `path`; `tail` keeps the last so many buckets of each key (retention)."""
    t = indexed(spark.read.parquet(path), ["bucket"])
    if tail:
        n = t.groupBy("seq_id").agg(F.max("idx").alias("n"))
        t = t.join(n, "seq_id").where(F.col("idx") > F.col("n") - tail).withColumn("idx", F.col("idx") - F.greatest(F.lit(0), F.col("n") - tail)).drop("n")
    return segment.segment(complete(t), name, k_max, curves=False).segment


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream, bucketed, and segmented."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    base = f"{shared_dir(spark)}/stratafold/stream-{uuid.uuid4().hex}"
    run_to_table(closed_buckets(stream, "event_type", "ts"), f"{base}/out", f"{base}/state")
    return resegment(spark, f"{base}/out")
