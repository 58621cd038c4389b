"""Readers, cards and records, sliding prediction, units and the report on approximate fits."""

import numpy as np
import pytest

from stratafold.__main__ import main
from stratafold.operators import diagnose, predict, quadrature, segment, sliding
from stratafold.sources import files
from stratafold.sources import sequences as src


def test_table_rows_and_chromosomes(spark, tmp_path):
    lines = [
        "chrBase\tchr\tbase\tstrand\tCoverage\tFREQC\tfreqT", "a\tc1\t30\tF\t10\t50\t50", "a\tc1\t10\tF\t4\t100\t0", "a\tc2\t5\tF\t2\t0\t100",
        "a\tc1\t20\tF\t0\t50\t50", "a\tc1\t21\tF\tnan\t50\t50", "a\tc1\t22\tF\t3\tnan\t50", "a\tc1\t23.5\tF\t3\t50\t50", "a\tc1\t24\tF\t3\t50", "",
    ]
    (tmp_path / "m.tsv").write_text("\n".join(lines))
    got = [tuple(r) for r in files.read_methylation(spark, str(tmp_path / "m.tsv")).orderBy("seq_id", "idx").collect()]
    assert got == [("c1", 1, 10.0, 0.999, 4.0), ("c1", 2, 30.0, 0.5, 10.0), ("c2", 1, 5.0, 0.001, 2.0)]
    (tmp_path / "one.csv").write_text("0.5\n1.0\n0.25\nx\n")
    assert [tuple(r)[1:] for r in files.read_methylation(spark, str(tmp_path / "one.csv")).select("seq_id", "idx", "x", "y").collect()] == [(1, 1.0, 0.5), (2, 2.0, 0.25)]


def test_probe_matrix(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 3)) * [1.0, 2.0, 0.5]
    text = [",".join(f"{x:.17g}" for x in row) for row in v]
    text[7] = "1.0,bad,2.0"
    (tmp_path / "m.csv").write_text("\n".join(text))
    t = files.read_probes(spark, str(tmp_path / "m.csv"), individuals=[0, 2, 9]).toPandas()
    keep = np.array([0, 2])
    y = v[:, keep].copy()
    y[7] = [1.0, 2.0]
    scale = np.stack([[max(1.4826 * np.median(np.abs(w - np.median(w))), 1e-3) for w in (y[max(0, i - 10) : i + 11, c] for i in range(60))] for c in range(2)], 1)
    for n, c in enumerate(keep):
        one = t[t["channel"] == c].sort_values("idx")
        assert np.allclose(one["y"], y[:, n]) and np.allclose(one["w"], (np.median(scale) / scale[:, n]) ** 2)
    assert files.read_probes(spark, str(tmp_path / "m.csv")).where("channel = 1").count() == 59
    with pytest.raises(ValueError):
        files.read_probes(spark, str(tmp_path / "m.csv"), individuals=[7])


def test_dated_closes(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,close\n2020-01-03,110\n2020-01-01,100\n2020-01-02,105\n2020-01-04,-1\n2021-01-01,90\n")
    got = [r["y"] for r in files.read_closes(spark, str(tmp_path / "c.csv"), "2020-01-01", "2021-01-01").orderBy("idx").collect()]
    want = np.log(np.diff(np.log([100, 105, 110])) ** 2 + 1e-12)
    assert np.allclose(got, want)
    (tmp_path / "p.txt").write_text("100\n105\n")
    with pytest.raises(ValueError):
        files.read_closes(spark, str(tmp_path / "p.txt"), start="2020-01-01")


def test_cards(spark, tmp_path):
    (tmp_path / "few.txt").write_text("\n".join(map(str, range(49))))
    assert files.load(spark, "welllog", str(tmp_path / "few.txt"))[1]["source"] == "simulated"
    for k in range(2):
        (tmp_path / f"v{k}.txt").write_text("\n".join(str(float(v)) for v in [*range(5000), k]))
    (seq, a), (_, b) = (files.load(spark, "welllog", str(tmp_path / f"v{k}.txt"), source_date="2020-05-01") for k in range(2))
    assert a["source"] == "file" and a["observations"] == 5001 and a["annotators"] and a["date"] == "2020-05-01" and a["data_sha256"] != b["data_sha256"]
    assert a["data_sha256"] == src.digest(seq.repartition(7, "y"), ["x", "y"])
    (tmp_path / "v.json").write_text('{"series": [{"raw": [' + ",".join(map(str, range(60))) + "]}]}")
    assert files.load(spark, "welllog", str(tmp_path / "v.json"))[1]["observations"] == 60
    for more in ({"stride": 0}, {"stride": True}):
        with pytest.raises(ValueError):
            files.load(spark, "spx", **more)
    with pytest.raises(TypeError):
        files.load(spark, "spx", source_date=2020)


def test_beta_draws_and_runs(spark, tmp_path):
    t = files.simulate(spark, "methylation", 3)
    one = t.toPandas()
    assert one.equals(t.toPandas())
    first = one["y"][:140]
    assert abs(first.mean() - 0.18) < 0.02 and abs(first.var() / (0.18 * 0.82 / 71) - 1) < 0.4
    for k in range(2):
        files.write_run(spark, str(tmp_path / "runs"), "cgh", "simulated", "figs/a.pdf", {"seed": k})
    got = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted(r["extra"]["seed"] for r in got.collect()) == ["0", "1"] and got.where("ran_at is null").count() == 0
    with pytest.raises(ValueError):
        files.write_run(spark, str(tmp_path / "runs"), "cgh", "simulated", "/a.pdf")


def test_sliding_prediction(spark):
    y = np.repeat([0.0, 3.0, -2.0], 40) + 0.1 * np.random.default_rng(1).normal(size=120)
    seq = src.complete(spark.createDataFrame([("s", k + 1, float(k), float(v)) for k, v in enumerate(y)], "seq_id string, idx int, x double, y double"))
    fitted = sliding.fit(seq, "gaussian", 4, 50, 20)
    asked = spark.createDataFrame([("s", 10.5), ("s", 60.0), ("s", 118.2)], "seq_id string, x double")
    got = sliding.predict(seq, fitted, asked).orderBy("x").toPandas()
    assert got["idx"].tolist() == [11, 61, 119] and np.abs(got["mean"] - [0, 3, -2]).max() < 0.2
    with pytest.raises(Exception, match="outside"):
        sliding.predict(seq, fitted, spark.createDataFrame([("s", 500.0)], "seq_id string, x double")).collect()


def test_units_and_groups(spark):
    p = spark.createDataFrame([(float(x),) for x in range(8)], "x double")
    got = {r["x"]: (r["unit_id"], r["low"], r["high"]) for r in predict.interval_units(p, [0, 2, 5]).collect()}
    assert got == {1.0: (0, 0.0, 2.0), 2.0: (0, 0.0, 2.0), 3.0: (1, 2.0, 5.0), 4.0: (1, 2.0, 5.0), 5.0: (1, 2.0, 5.0)}
    s = spark.createDataFrame([(0, "a", -1.0), (1, "a", -2.0), (0, "b", -2.0), (1, "b", -2.0)], "unit_id int, seq_id string, log_density double")
    g = {r["seq_id"]: r for r in predict.predict_group(s, spark.createDataFrame([("a", 1.0), ("b", 0.0)], "seq_id string, weight double")).collect()}
    assert g["a"]["log_score"] == -3 and g["b"]["log_score"] == -4 and g["a"]["prob"] == 1 and g["b"]["prob"] < 1e-200
    g = {r["seq_id"]: r["prob"] for r in predict.predict_group(s).collect()}
    assert abs(g["a"] - 1 / (1 + np.exp(-1))) < 1e-12


def test_report_on_an_approximation(spark):
    rng = np.random.default_rng(2)
    rows = [("s", k + 1, float(k), float(rng.binomial(12, 0.2 if k < 10 else 0.7)), 12.0) for k in range(20)]
    seq = src.complete(spark.createDataFrame(rows, "seq_id string, idx int, x double, y double, n_trials double"))
    h = spark.createDataFrame([("s", 0.0, 1.0)], "seq_id string, nu double, rho2 double")
    blocks = {m: quadrature.approximate_blocks(seq, h, m).cache() for m in ("quadrature", "laplace")}
    fits = {m: segment.fit_blocks(b, 3) for m, b in blocks.items()}
    r = diagnose.non_conjugate(fits["laplace"], fits["quadrature"], blocks["laplace"], blocks["quadrature"], 3).first()
    assert r["mismatched"] == 0 and r["bound_holds"] and r["jaccard"] == 1 and 0 < r["tv"] < 0.05
    assert abs(r["quantiles"][2] - r["max_error"]) < 1e-12 and abs(r["quantiles"][0] - r["median_error"]) < 1e-12


def test_command_line(spark, tmp_path, capsys):
    assert main(["synthetic", "cgh", "8"]) == 0 and '"source": "simulated"' in capsys.readouterr().out
    assert main(["synthetic", "nothing"]) == 2 and main(["realdata", "cgh"]) == 2
