"""Order-independent sums against math.fsum, and bit for bit over partitionings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratafold.functions.exact import exact_avg, exact_sum
from stratafold.operators import pooled


def cases():
    rng = random.Random(3)
    yield "cancel", [1e16, 1.0, -1e16, 3.0, 2.0**-30] * 50
    yield "spread", [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 12) for _ in range(800)]
    yield "large", [rng.uniform(-1, 1) * 2.0**88 for _ in range(300)] + [0.25]
    yield "one", [0.1]
    yield "thirds", [1 / 3] * 999
    yield "negative", [-1e-3 * k for k in range(500)]
    x = [rng.gauss(0, 1e9) for _ in range(400)]
    yield "nought", x + [-v for v in x]
    yield "carries", [2.0**-21 + 2.0**-70] * 900 + [2.0**39 + 0.5] * 900


def test_equals_fsum_for_any_partitioning(spark):
    rows = [(k, v) for k, xs in cases() for v in xs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    bits = set()
    for parts in (1, 7, 60):
        got = {r.k: (r.s, r.m) for r in df.repartition(parts).groupBy("k").agg(exact_sum("v").alias("s"), exact_avg("v").alias("m")).collect()}
        bits.add(tuple(sorted((k, s.hex(), m.hex()) for k, (s, m) in got.items())))
    assert len(bits) == 1
    for k, xs in cases():
        want = math.fsum(xs)
        assert abs(got[k][0] - want) <= math.ulp(want) + len(xs) * 2.0**-81, k
        assert abs(got[k][1] - want / len(xs)) <= 2 * math.ulp(want / len(xs)) + 2.0**-81, k


def test_odd_values(spark):
    rows = [("null", None), ("nan", 1.0), ("nan", float("nan")), ("inf", 2.0), ("inf", float("inf")), ("huge", 1e300), ("huge", 1.0), ("some", None), ("some", 4.0), ("zero", -0.0)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string, v double").groupBy("k").agg(exact_sum("v").alias("s")).collect()}
    assert got["null"] is None and math.isnan(got["nan"]) and got["inf"] == math.inf and got["huge"] == 1e300 and got["some"] == 4.0 and got["zero"] == 0.0
    assert spark.createDataFrame([], "v double").agg(exact_sum("v").alias("s")).first().s is None


@pytest.mark.parametrize("members", [3, 40])
def test_pooled_evidence_keeps_its_bits(spark, members):
    rng = random.Random(members)
    rows = [("a", str(m), i, j, rng.uniform(-1e6, 1e3), rng.random()) for m in range(members) for i in range(5) for j in range(i + 1, 6)]
    seen = set()
    for parts in (1, 200):
        rng.shuffle(rows)
        b = spark.createDataFrame(rows, "seq_id string, member string, i int, j int, log_a0 double, a1 double").repartition(parts)
        seen.add(tuple((r.i, r.j, r.log_a0.hex(), r.a1.hex()) for r in pooled.pool(b).orderBy("i", "j").collect()))
    assert len(seen) == 1
    by = {}
    for _, _, i, j, v, _ in rows:
        by.setdefault((i, j), []).append(v)
    assert all(abs(float.fromhex(h) - math.fsum(by[i, j])) <= math.ulp(math.fsum(by[i, j])) for i, j, h, _ in next(iter(seen)))


def test_sums_combine_before_the_shuffle(spark, capsys):
    spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v")).groupBy("k").agg(exact_sum("v")).explain()
    assert "partial_sum" in capsys.readouterr().out
