"""Exact deduplication: groups against a dictionary of normalised texts, the directory against its invariants."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratafold.llm import exact

TEXTS = ["a b", "a  b", "a\tb", " a b", "a b ", "", None, " ", "\n\t", "é x", "é x", "A b", "long " * 4000, "long  " * 4000]


def brute(rows):
    """doc_id -> (keep_id, group_size, sha256), by row; how many of a group's rows stay is one."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out


ordered = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("hot,most,bits,capacity", [(32, 100, 64, 1 << 20), (2, 100, 64, 64), (2, 1, 64, 64), (2, 100, 2, 64), (10_000, 1, 0, 1), (1, 100, 3, 4096)])
def test_equals_brute_force(spark, hot, most, bits, capacity):
    rows = [(i, TEXTS[i * i % 97 % len(TEXTS)]) for i in range(150)] + [(7, "a b"), (7, "a b"), (None, "a b"), (None, "only nulls"), (None, "only nulls")] + [(1000 + i, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame([(i, t, "clash", 0, 1) for i, t in rows], "doc_id long, text string, key string, keep_id int, bucket int").repartition(5)
    out = exact.exact_groups(docs, capacity, hot, most, bits).collect()
    assert ordered((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == ordered(brute(rows))
    stays = defaultdict(int)
    for r in out:
        stays[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(stays.values()) == {1}


def test_directory_splits_only_overfull_buckets(spark):
    capacity = 1000
    keys = spark.range(400).select(F.xxhash64("id").alias("key"), F.when(F.col("id") == 3, 5000).otherwise(F.pmod("id", F.lit(90)) + 1).cast("long").alias("load"))
    slots, depth = exact.directory(keys, capacity)
    rows = {r.slot: r.bucket for r in slots.collect()}
    held = defaultdict(list)
    for r in keys.collect():
        held[rows[(r.key % (1 << 64)) >> (64 - depth)]].append(r.load)
    assert all(sum(v) <= capacity or len(v) == 1 or depth >= exact.MORE_BITS for v in held.values())
    names = [rows[s] for s in sorted(rows)]
    assert names == sorted(names) and len(set(names)) > 1  # a bucket is one range of keys


def test_many_equal_keys_end_the_doubling(spark):
    keys = spark.createDataFrame([(5, 10**9), (6, 10**9)], "key long, load long")
    slots, depth = exact.directory(keys, 1)
    assert depth <= 63 and slots.where(f"slot = shiftrightunsigned(5L, {64 - depth})").count() == 1


def test_empty_and_odd(spark, odd_docs, no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    out = exact.exact_groups(odd_docs).collect()
    assert len(out) == odd_docs.count() and sum(r.kept for r in out) == len({r.text_sha256 for r in out})
