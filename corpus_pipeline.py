"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, personal data, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
`documents`. `run` writes every stage's result to the shared folder and reads it again.

Decisions. Language ID drops documents without a letter (`und`) and those in which no language has half of the letters.
Near-dedup keeps one row of each group (five-word shingles, similarity 0.8 or more): that with the smallest id, of rows
with equal ids that with the smallest text hash. Rows that share an id but not a text are different documents.
Decontamination drops documents that hold a benchmark window. Personal data is replaced by its kind in brackets, and
n_chars follows. Encoding returns doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and text.

Defined cases. Null text has no language and goes. A null id comes last in its group and is otherwise a document like any
other. Repeated rows are copies: one stays. Empty tables pass through. Extra columns are dropped at the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import bpe, decontaminate, language, pii, simhash
from stratafold.llm.common import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its language has at least this share of its letters.
SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.learnt(docs))
    return found.where((F.col("lang_pred") != language.UND) & (F.col("score") >= SHARE)).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = materialise(docs.withColumn("row", F.monotonically_increasing_id()))  # written once: a retry sees the same
    found = simhash.near_classes(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "row")
    first = found.groupBy("root").agg(F.min(key).alias("key")).select("key.row")
    return docs.join(first, "row", "left_semi").drop("row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("hit_doc"), "text_key")
    return docs.join(hits, docs.doc_id.eqNullSafe(F.col("hit_doc")) & (F.xxhash64(docs.text) == F.col("text_key")), "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs.select(*COLUMNS), pii.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode(docs, public_tokenizers.path(bpe.WORD_BPE))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
