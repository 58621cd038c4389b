import numpy as np
import pandas as pd
import pytest

from stratafold.operators import baselines, diagnose, families, metrics, mixture, pooled, prior, quadrature, segment, sliding
from stratafold.sources import files
from stratafold.sources import sequences as src


def piecewise(spark, name, levels, width=30, seed=1, draw=None):
    rng = np.random.default_rng(seed)
    y = np.concatenate([(draw or (lambda m, n: rng.normal(m, 0.25, n)))(m, width) for m in levels])
    return src.complete(spark.createDataFrame([(name, k + 1, float(k), float(v)) for k, v in enumerate(y)], "seq_id string, idx int, x double, y double"))


def cuts(fit):
    return [r["boundaries"] for r in fit.rows.collect()]


def test_gaussian_recovery(spark):
    fit = segment.segment(piecewise(spark, "g", [0, 2, -1, 3]), "gaussian", 8)
    assert cuts(fit) == [[0, 30, 60, 90, 120]]
    assert diagnose.invariants(fit).where("not passed").count() == 0
    assert fit.curve.count() == 120 and fit.map_curve.count() == 120


@pytest.mark.parametrize(
    "name,levels,draw",
    [
        ("poisson", [2, 12, 3], lambda rng: lambda m, n: rng.poisson(m, n)),
        ("bernoulli", [0.05, 0.9, 0.1], lambda rng: lambda m, n: rng.random(n) < m),
        ("beta", [0.2, 0.7, 0.3], lambda rng: lambda m, n: np.clip(rng.beta(50 * m, 50 * (1 - m), n), 1e-3, 1 - 1e-3)),
        ("negbin", [2, 20, 3], lambda rng: lambda m, n: rng.poisson(m, n)),
    ],
)
def test_other_families(spark, name, levels, draw):
    s = piecewise(spark, name, levels, 40, draw=draw(np.random.default_rng(5)))
    # 0/1 rows have no extra variance to estimate from: their prior is given
    h = None if name == "poisson" else spark.createDataFrame([(name, 1.0, 1.0)], "seq_id string, alpha double, beta double")
    got = cuts(segment.segment(s, name, 6, h))[0]
    assert len(got) == 4 and all(abs(a - b) <= 6 for a, b in zip(got, [0, 40, 80, 120]))


def test_kernel_equals_block_table(spark):
    s = piecewise(spark, "g", [0, 1], 10)
    h = families.hyper(s, "gaussian")
    a = segment.segment(s, "gaussian", 4, h).posterior_k.toPandas().sort_values("k")
    b = segment.fit_blocks(families.blocks(s, "gaussian", h), 4).posterior_k.toPandas().sort_values("k")
    assert np.allclose(a["log_post"], b["log_post"], atol=1e-8)


def test_edges(spark):
    one = piecewise(spark, "one", [1.0], 1)
    assert cuts(segment.segment(one, "gaussian", 5)) == [[0, 1]]
    flat = src.complete(spark.createDataFrame([("f", k, float(k), 2.0) for k in range(1, 9)], "seq_id string, idx int, x double, y double"))
    assert cuts(segment.segment(flat, "poisson", 3))[0] == [0, 8]
    masked = src.complete(spark.createDataFrame([("m", k, float(k), float("nan") if k == 3 else 1.0, k != 3) for k in range(1, 7)], "seq_id string, idx int, x double, y double, observed boolean"))
    assert segment.segment(masked, "gaussian", 2).rows.first()["log_evidence"] is not None
    impossible = segment.segment(piecewise(spark, "i", [0.0], 6), "gaussian", 2, min_len=7).rows.first()
    assert "no admissible" in impossible["error"]
    assert families.hyper(flat.where("idx < 0"), "gaussian").count() == 0
    assert [r["n_gaps"] for r in src.violations(flat).collect()] == [0]


def test_counts_without_exposure_rows_are_neutral(spark):
    rows = [("e", 1, 1.0, 0.0, 0.0), ("e", 2, 2.0, 3.0, 1.0)]
    s = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double, w double"))
    h = spark.createDataFrame([("e", 2.0, 1.0)], "seq_id string, alpha double, beta double")
    b = {(r["i"], r["j"]): r["log_a0"] for r in families.blocks(s, "poisson", h).collect()}
    assert abs(b[(0, 1)]) < 1e-9 and abs(b[(0, 2)] - b[(1, 2)]) < 1e-9


def test_count_priors():
    assert np.allclose(np.exp(prior.count_prior(None, 3)), [4 / 7, 2 / 7, 1 / 7])
    assert np.allclose(np.exp(prior.count_prior("uniform", 4)), 0.25)
    with pytest.raises(ValueError):
        prior.count_prior(lambda k: -1.0, 2)


def test_quadrature_families():
    s, n = np.array([3.0, 30.0]), np.array([8.0, 32.0])
    exact, _ = quadrature.gh(s, n, 0.3, 2.0, 120)
    assert abs(exact[0] + 6.1962) < 1e-3
    assert np.abs(quadrature.laplace(s, n, 0.3, 2.0)[0] - exact).max() < 0.05
    bound = quadrature.jaakkola(s, n, 0.3, 2.0)[0]
    assert (bound <= exact + 1e-9).all() and np.abs(bound - exact).max() < 0.5
    y = np.array([1.0] * 3 + [0.0] * 5)
    assert abs(quadrature.expectation(y, np.ones(8), 0.3, 2.0)[0] + 6.1969) < 1e-3
    pdf = pd.DataFrame({"y": [0.2, 0.7], "w": 1.0, "a": 1.0, "phi": 20.0})
    ev, mean = quadrature.beta_obs(pdf, {"alpha": 2.0, "beta": 2.0}, 64)
    assert 0.2 < mean[0, 2] < 0.7 and np.isfinite(ev[0, 2])
    with pytest.raises(ValueError):
        quadrature.beta_obs(pdf.assign(y=1.0), {"alpha": 2.0, "beta": 2.0})


def test_shared_boundaries_beat_single(spark):
    parts = [piecewise(spark, "s", [0, 0.6], 20, seed=k).withColumn("member", src.F.lit(k)) for k in range(4)]
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    fit, means = pooled.shared(s, "gaussian", "member", 4, None)
    assert abs(cuts(fit)[0][1] - 20) <= 2 and means.select("member").distinct().count() == 4


def test_mixture_separates(spark):
    rows, rng = [], np.random.default_rng(0)
    for k in range(6):
        at = 10 if k % 2 else 20
        y = np.concatenate([rng.normal(0, 0.2, at), rng.normal(2, 0.2, 30 - at)])
        rows += [(f"s{k}", i + 1, float(i), float(v)) for i, v in enumerate(y)]
    s = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double"))
    out = mixture.fit(families.blocks(s, "gaussian", families.hyper(s, "gaussian", "var")), 2, 3, 2, rounds=6)
    hard = out["members"].where("r > 0.5").toPandas().set_index("seq_id")["g"]
    assert len({hard["s0"], hard["s2"], hard["s4"]}) == 1 and hard["s0"] != hard["s1"]


def test_sliding_windows_cover(spark):
    s = piecewise(spark, "w", [0, 2, 0], 30)
    w = sliding.windows(s, 40, 10)
    assert w.groupBy("seq_id").count().where("count <> 40").count() == 0
    out = sliding.fit(s, "gaussian", 4, 40, 10)
    assert {30, 60} <= {r["pos"] for r in out["boundaries"].collect()} and out["curve"].count() == 90


def test_baselines():
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(m, 0.3, 25) for m in (0, 3, 1)])
    c = baselines.Cost(y)
    assert baselines.optimal(c, 2) == [0, 25, 50, 75]
    assert baselines.pelt(c, 2.0) == baselines.penalised(c, 2.0, list(range(76)))
    assert baselines.binary_segmentation(c, changes=2) == [0, 25, 50, 75]
    assert baselines.wild_binary_segmentation(c, changes=2) == [0, 25, 50, 75]


def test_matching():
    assert metrics.match([1, 2], [2, 3], 1) == [(1, 2), (2, 3)]
    assert len(metrics.greedy_match([1, 2], [2, 3], 1)) == 1
    assert metrics.match([], [1], 5) == []


def test_readers_and_simulators(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1.5\nbad\n2.5\nNaN\n")
    assert [r["y"] for r in files.read_values(spark, str(tmp_path / "v.txt")).orderBy("idx").collect()] == [1.5, 2.5]
    (tmp_path / "v.json").write_text('{"series": [{"raw": [1.0, 2.0]}]}')
    assert files.read_json_values(spark, str(tmp_path / "v.json")).count() == 2
    (tmp_path / "m.tsv").write_text("chrBase\tchr\tbase\tstrand\tcoverage\tfreqC\tfreqT\nx\tc1\t5\tF\t10\t100\t0\ny\tc1\t3\tF\t0\t5\t95\nz\tc1\t2\tF\t4\t50\t50\n")
    m = files.read_methylation(spark, str(tmp_path / "m.tsv")).orderBy("idx").collect()
    assert [(r["x"], r["y"], r["w"]) for r in m] == [(2.0, 0.5, 4.0), (5.0, 0.999, 10.0)]
    for shape, pieces in files.SHAPES.items():
        t = files.simulate(spark, shape)
        assert t.count() == sum(n for _, n in pieces) and t.where("y is null or isnan(y)").count() == 0
    assert [sum(n for _, n in files.SHAPES[k]) for k in ("welllog", "cgh", "spx", "methylation")] == [4050, 1100, 1500, 600]
    assert files.annotations(spark).where("annotator = '12'").orderBy("pos").first()["pos"] == 1062
    seq, card = files.load(spark, "cgh", stride=5)
    assert seq.count() == 220 and card["boundaries"][0] == 76
    rec = files.record("r1", "ok", {"a": "0" * 64}, ["out/x.json"], {"m": 1.0})
    files.write_record(spark, rec, str(tmp_path / "rec"))
    assert files.read_record(spark, str(tmp_path / "rec")) == rec
    with pytest.raises(ValueError):
        files.record("r1", "ok", {}, ["/abs"], {})


def test_remembered_and_requests(spark):
    from stratafold.operators import lineage

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = f"k{np.random.default_rng().integers(1 << 40)}"
    assert lineage.remembered(spark, key, build).count() == lineage.remembered(spark, key, build).count() == 3 and len(calls) == 1
    s = piecewise(spark, "r", [0, 1], 5)
    assert baselines.request(s, "univariate", 10).count() == 10
    with pytest.raises(Exception, match="increasing"):
        baselines.request(s.withColumn("x", src.F.lit(1.0)), "univariate", 10).collect()
    with pytest.raises(KeyError):
        baselines.detect(s, "unknown")


def test_blocks_of_a_long_sequence_are_made_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratafold.plans import queries

    spark.createDataFrame([(7 * k, k * k % 3 % 2, k % 5 // 4) for k in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.QUERIES["bernoulli_blocks"](spark, str(tmp_path))
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 1200 * 1201 and len(tasks) > 4  # before: one task a sequence
    rows = [(q, k, float(k), float(k * k % 3)) for q, n in (("a", 23), ("b", 1), ("c", 8)) for k in range(1, n + 1)]
    seq = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double"))
    h = seq.select("seq_id").distinct().withColumns({"alpha": F.lit(2.0), "beta": F.lit(3.0)})
    for limits in ({}, {"min_len": 3, "max_len": 6}):
        one, many = (sorted(map(tuple, families.blocks(seq, "poisson", h, tile=t, **limits).collect())) for t in (None, 4))
        assert one == many and one


def test_shuffle_of_long_block_tables_grows_with_the_rows(spark):
    from pyspark.sql import functions as F

    sc = spark.sparkContext._jsc.sc()

    def shuffled(n):
        seq = src.complete(spark.range(1, n + 1).select(F.lit("a").alias("seq_id"), F.col("id").cast("int").alias("idx"), F.col("id").alias("x"), (F.col("id") * F.col("id") % 7 % 2).alias("y")))
        h = seq.select("seq_id").distinct().withColumns({"alpha": F.lit(2.0), "beta": F.lit(3.0)})

        def total():
            sc.listenerBus().waitUntilEmpty(20_000)
            return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

        before = total()
        assert families.blocks(seq, "bernoulli", h, tile=4).agg(F.count("log_a0"), F.sum(F.col("j") - F.col("i"))).first() == (n * (n + 1) // 2, n * (n + 1) * (n + 2) // 6)
        return total() - before

    shuffled(100)
    few, many = shuffled(500), shuffled(4000)
    assert many < 16 * few  # 8 times the rows; before: every row once for each tile, 64 times as much


def test_gathered_blocks_of_odd_sequences(spark):
    """Sums that are null, no whole numbers, wide or infinite, and lengths at the edges of tiles."""
    from pyspark.sql import functions as F

    odd = {
        "null": lambda k: (None if k < 6 or k % 7 == 0 else k % 2, 1.0), "all null": lambda k: (None, 1.0), "part": lambda k: (k % 3 / 2, 0.3 + k % 4), "wide": lambda k: (k % 2 * 40_000.0, 90_000.0),
        "alike": lambda k: (1.0, 1.0), "hidden": lambda k: (k % 2, float(k % 5 > 2)), "one": lambda k: (1.0, 1.0), "not a number": lambda k: (float("nan") if k == 30 else 1.0, 1.0),
    }
    rows = [(q, k, float(k), None if f(k)[0] is None else float(f(k)[0]), f(k)[1]) for q, f in odd.items() for k in range(1, 2 if q == "one" else 60)]
    seq = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double, w double"))
    h = seq.select("seq_id").distinct().withColumns({"alpha": F.lit(2.0), "beta": F.lit(3.0)})
    for limits in ({}, {"min_len": 9, "max_len": 9}, {"max_len": 1}, {"min_len": 58}):
        one, many = (sorted(map(str, families.blocks(seq, "bernoulli", h, tile=t, **limits).collect())) for t in (None, 8))
        assert one == many and one
    g = families.gathered(seq.where("seq_id in ('hidden', 'alike')"), "bernoulli", h, tile=64)
    sizes = {r["seq_id"]: (r["groups"], r["blocks"]) for r in g.groupBy("seq_id").agg(F.count("*").alias("groups"), F.sum(F.size("starts")).alias("blocks")).collect()}
    assert sizes["alike"] == (59, 59 * 30) and sizes["hidden"][1] == 59 * 30 and sizes["hidden"][0] < 300
