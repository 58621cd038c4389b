"""Shared plumbing of the training-data operators: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch handed to Python; texts can be long, so batches stay short.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of `sf_dir`; also keeps the Arrow batches of this session short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all runs in one process
    (tests) a temporary folder takes its place; on a cluster no other folder is known to be shared."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/stratafold-checkpoint-{uuid.uuid4().hex[:8]}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratafold/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Frees what `materialise` wrote for `df`, by an empty table in its place; nothing unread may depend on it."""
    path = df.written_at
    df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


def frequent(words: DataFrame, most: int) -> list:
    """At most `most` rows (word, c, ...), largest counts first, ties by word: all words whose count reaches the smallest
    threshold that so few reach. The threshold comes from a histogram of counts (some hundred rows), so the driver never
    sees a task's own list of candidates."""
    level = F.floor(F.log2("c") * 8).cast("int")
    total, least = 0, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["level"]
    rows = words.where(level >= least).collect() if least is not None else []
    return sorted(rows, key=lambda r: (-r["c"], r["word"]))


def lower_ascii(col):
    """A-Z to a-z and nothing else. Pure ASCII texts take lower(), which is the same there and faster."""
    import string

    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )
