"""Points in overlapping intervals against nested loops."""

import math
import random

import pytest

from stratafold.operators import units


@pytest.fixture(scope="module")
def data():
    rng = random.Random(9)
    points = [(f"s{rng.randrange(3)}", rng.choice([rng.uniform(-50, 50), float(rng.randint(-50, 50)), rng.gauss(0, 1e-3)]), k, rng.gauss(-3, 2)) for k in range(700)]
    iv = []
    for k in range(250):
        a = rng.choice([rng.uniform(-60, 60), float(rng.randint(-50, 50)), rng.gauss(0, 1e-3)])
        iv.append((f"s{rng.randrange(4)}", k, a, a + rng.choice([1.0, 2.0, 4.0, 2.0 ** rng.randint(-20, 8), rng.uniform(0, 100)])))
    iv += [("s0", 900, -math.inf, 0.0), ("s0", 901, 3.0, math.inf), ("s1", 902, -math.inf, math.inf), ("s1", 903, 5.0, 5.0), ("s1", 904, 5.0, 1.0), ("s2", 905, 1e300, 2e300), ("s2", 906, 0.0, math.nan), ("s2", 907, None, 3.0), ("s0", 908, -1e-320, 1e-320), ("s0", 908, 1.0, 2.0)]
    return points + [("s0", 0.0, 800, -1.0), ("s1", math.nan, 801, -1.0), ("s1", None, 802, -1.0), ("s9", 1.0, 803, -1.0)], iv


def inside(x, low, high):
    return None not in (x, low, high) and not math.isnan(high) and low < x <= high


def frames(spark, data):
    points = spark.createDataFrame(data[0], "seq_id string, x double, point int, log_density double")
    return points, spark.createDataFrame(data[1], "seq_id string, unit_id int, low double, high double")


def test_equals_nested_loops(spark, data):
    want = sorted((p[2], u[1], u[2]) for p in data[0] for u in data[1] if p[0] == u[0] and inside(p[1], u[2], u[3]))
    got = sorted((r.point, r.unit_id, r.low) for r in units.in_intervals(*frames(spark, data)).collect())
    assert got == want and len(want) > 1000


def test_sums_of_units(spark, data):
    got = {(r.unit_id, r.low): (r.n_points, r.log_score) for r in units.unit_log_likelihood(*frames(spark, data)).collect() if r.low == r.low and r.low is not None}
    for s, u, low, high in data[1]:
        if low is not None:
            v = [p[3] for p in data[0] if p[0] == s and inside(p[1], low, high)]
            assert got[u, low][0] == len(v) and abs(got[u, low][1] - math.fsum(v)) < 1e-12


def test_no_nested_loop_in_the_plan(spark, data, capsys):
    units.in_intervals(*frames(spark, data)).explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark, data):
    points, iv = frames(spark, data)
    assert units.in_intervals(points, iv.where("false")).count() == 0 and units.in_intervals(points.where("false"), iv).count() == 0
    assert units.unit_log_likelihood(points.where("false"), iv).where("log_score <> 0").count() == 0
