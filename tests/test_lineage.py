"""Fits kept by what they are made from, priors recovered from fits, intervals by weights."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.operators import families, lineage, metrics, prior, segment
from stratafold.sources import sequences as src


@pytest.fixture(scope="module")
def seq(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i + 1, float(i + (i > 7) * 2), float((4 if i >= 9 else 0) + rng.normal())) for s in ("a", "b") for i in range(20 if s == "a" else 3)]
    return src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double")).cache()


def test_digest_follows_content_not_order(seq):
    d = lineage.table_digest(seq)
    assert d == lineage.table_digest(seq.repartition(7)) == lineage.table_digest(seq.select(*reversed(seq.columns)))
    for other in (seq.withColumn("y", F.col("y") + F.when(F.col("idx") == 3, 1e-12).otherwise(0.0)), seq.unionByName(seq.limit(1)), seq.where("idx > 1"), seq.withColumnRenamed("y", "yy"), seq.withColumn("idx", F.col("idx").cast("long"))):
        assert lineage.table_digest(other) != d


def test_key_follows_parameters(seq):
    def key(**params):
        return lineage.cache_key(seq, params)

    rate = 2.0
    same = [key(k=3, count=lambda k: rate / k), key(count=lambda k: rate / k, k=3)]
    assert same[0] == same[1]
    other = {key(k=4, count=lambda k: rate / k), key(k=3, count=lambda k: 3.0 / k), key(k=3.0), key(k=3), key(k="3"), key(k=(3,)), key(k=None), lineage.cache_key(seq, {"k": 3}, "more"), key(p=prior.Partition(power=1.0)), key(p=prior.Partition(power=2.0)), key(k=np.float64(0.5)), key(k=np.arange(3))}
    assert len(other) == 12 and same[0] not in other
    with pytest.raises(TypeError):
        key(k=object())


def test_fit_or_load(spark, seq, monkeypatch):
    calls = []

    def build():
        calls.append(1)
        return segment.segment(seq, "gaussian", 3, curves=False).rows

    key = lineage.cache_key(seq, {"family": "gaussian", "k_max": 3, "run": np.random.default_rng().integers(1 << 40)})
    a = lineage.fit_or_load(spark, key, build, ["seq_id", "k_map", "log_post"])
    b = lineage.fit_or_load(spark, key, build, ["seq_id", "k_map", "log_post"])
    assert a.columns == ["seq_id", "k_map", "log_post"] and sorted(a.collect()) == sorted(b.collect()) and len(calls) == 1
    monkeypatch.setenv(lineage.BYPASS, "1")
    assert sorted(lineage.fit_or_load(spark, key, build, ["seq_id", "k_map", "log_post"]).collect()) == sorted(a.collect()) and len(calls) == 2


def test_two_writers_do_not_clash(spark):
    key, out, gate = f"race{np.random.default_rng().integers(1 << 40)}", [], threading.Barrier(2)

    def build(n):
        gate.wait()  # both have looked and found nothing
        return spark.range(n)

    def write(n):
        out.append(lineage.fit_or_load(spark, key, lambda: build(n)).count())

    threads = [threading.Thread(target=write, args=(n,)) for n in (3, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    later = [lineage.fit_or_load(spark, key, lambda: 1 / 0).count() for _ in range(3)]
    assert len(out) == 2 and set(out) <= {3, 5} and len(set(later)) == 1 and later[0] in (3, 5)


def test_half_written_versions_are_not_read(spark):
    key = f"half{np.random.default_rng().integers(1 << 40)}"
    base = f"{lineage.shared_dir(spark)}/stratafold/kept-{key}"
    spark.range(2).write.parquet(f"{base}/0000")  # a writer that was lost before it published
    assert lineage.fit_or_load(spark, key, lambda: spark.range(4)).count() == 4


def test_prior_is_kept_and_exchanged(seq):
    h = families.hyper(seq, "gaussian")
    fit = segment.segment(seq, "gaussian", 4, h, count=0.1, curves=False)
    kept = {(r.seq_id, r.k): r.log_p for r in fit.count_prior.collect()}
    assert np.allclose([kept["a", k] for k in (1, 2, 3, 4)], prior.count_prior(0.1, 4)) and np.allclose([kept["b", k] for k in (1, 2, 3)], prior.count_prior(0.1, 3))
    for count in (None, "uniform", 0.7, lambda k: 1.0 / k):
        got = {(r.seq_id, r.k): (r.log_post, r.log_evidence) for r in fit.under(count).collect()}
        for r in segment.segment(seq, "gaussian", 4, h, count=0.1 if count is None else count, curves=False).rows.collect():
            assert np.allclose([got[r.seq_id, k + 1][0] for k in range(r.k_max)], r.log_post) and abs(got[r.seq_id, 1][1] - r.log_evidence) < 1e-9


def test_span_prior_is_one_function(seq):
    """The block table and the kernel, dense and over tiles, under a function of the span on an uneven axis."""
    own = lambda x, ns: ns.where(x <= 15.0, -0.3 * x + ns.ln(x), float("-inf"))
    h = families.hyper(seq, "gaussian")
    b = prior.with_prior(families.blocks(seq, "gaussian", h), src.bounds(seq), prior.Partition(span=own))
    fits = [segment.fit_blocks(b, 4), *(segment.segment(seq, "gaussian", 4, h, span=own, on_axis=True, dense_rows=d) for d in (1000, 0))]
    rows = [{r.seq_id: r for r in f.rows.collect()} for f in fits]
    for s in ("a", "b"):
        for c in ("log_c", "log_left_n", "log_post", "marginal_mixed", "curve_mixed", "boundaries"):
            x, y, z = (np.array(r[s][c], float) for r in rows)
            assert np.allclose(x, y) and np.allclose(x, z), c
    assert b.where("j - i > 15").count() == 0


def test_bootstrap_interval(spark, capsys):
    rng = np.random.default_rng(0)
    v = {g: rng.normal(m, s, n) for g, m, s, n in (("a", 5, 2, 400), ("b", -1, 1, 30), ("c", 7, 0, 1))}
    df = spark.createDataFrame([(g, k, float(x)) for g, xs in v.items() for k, x in enumerate(xs)] + [("a", 999, None)], "g string, k int, v double")
    got = {r.g: r for r in metrics.bootstrap_ci(df, "g", "v", ["k"], 1000).collect()}
    again = {r.g: r for r in metrics.bootstrap_ci(df.repartition(13), "g", "v", ["k"], 1000).collect()}
    assert all(np.allclose(got[g][1:], again[g][1:], rtol=1e-12) for g in v)
    for g in ("a", "b"):
        means = v[g][rng.integers(0, len(v[g]), (4000, len(v[g])))].mean(axis=1)
        low, high = np.percentile(means, [2.5, 97.5])
        width = high - low
        assert abs(got[g].low - low) < 0.15 * width and abs(got[g].high - high) < 0.15 * width and abs(got[g].mean - v[g].mean()) < 1e-12
    assert got["c"].low == got["c"].high == v["c"][0]
    w = metrics.bootstrap_weights(df.where("v is not null"), ["g", "k"], 200).groupBy("w").count().collect()
    n = 431 * 200
    assert all(abs(r["count"] / n - np.exp(-1) / float(np.prod(np.arange(1, r.w + 1)))) < 0.01 for r in w)
    metrics.bootstrap_ci(df, "g", "v", ["k"], 100).explain()
    assert "partial_sum" in capsys.readouterr().out
