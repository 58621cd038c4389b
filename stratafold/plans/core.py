"""Queries over sequences, hyperparameters, blocks, priors and posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import families, prior, segment
from ..sources import sequences as src
from .registry import EB, FAMILY, PATH, SEQ, finite_rounded, load, query, rounded, sql_backward, sql_best, sql_blocks, sql_forward, sql_posterior

GIVEN = {
    "gaussian": {"nu": 50.0, "rho2": 400.0, "sigma2": 900.0},
    "poisson": {"alpha": 2.0, "beta": 0.03},
    "binomial": {"alpha": 2.0, "beta": 3.0},
    "bernoulli": {"alpha": 2.0, "beta": 1.0},
    "beta": {"alpha": 4.0, "beta": 4.0},
    "negbin": {"alpha": 3.0, "beta": 20.0},
}
SOURCE = {
    "events": ("events", src.events_daily), "values": ("events", src.events_value_daily), "errors": ("events", src.error_rate_daily),
    "ship": ("lineitem", src.shipments_monthly), "discount": ("lineitem", src.discount_monthly), "orders": ("orders", src.orders_monthly), "labels": ("labels", src.labels_binary),
}


def sequence(spark, sf, name):
    t, build = SOURCE[name]
    return src.complete(build(load(spark, sf, t)))


def given(seq, fam):
    """Fixed hyperparameters for every sequence."""
    return seq.select("seq_id").distinct().select("seq_id", *[F.lit(v).alias(k) for k, v in GIVEN[fam].items()])


def block_table(seq, fam, **kw):
    return families.blocks(seq, fam, given(seq, fam), **kw)


# ---- sequences -------------------------------------------------------------------------------------------------------


def _register_sequences():
    for name in SOURCE:
        cols = [c for c in ("y", "w", "n_trials", "phi") if c == "y" or f" as {c}" in SEQ[name]]

        def run(spark, sf, name=name, cols=cols):
            return rounded(sequence(spark, sf, name).select("seq_id", "idx", *cols))

        run.__name__ = f"seq_{name}"
        query(f"select seq_id, idx, {', '.join(f'round({c}, 6) as {c}' for c in cols)} from ({SEQ[name]})")(run)


_register_sequences()


@query(f"with s as ({SEQ['values']}), d as (select *, lag(idx) over w as p, lead(idx) over w as q from s window w as (partition by seq_id order by idx)) select seq_id, idx as pos, round(case when q is not null then (idx + q) / 2.0 else idx + coalesce((idx - p) / 2.0, 0.5) end, 6) as u from d union all select seq_id, 0, round(idx - coalesce((q - idx) / 2.0, 0.5), 6) from d where idx = 1")
def midpoint_bounds(spark, sf):
    return rounded(src.bounds(sequence(spark, sf, "values")).select("seq_id", "pos", "u"))


@query(f"with s as ({SEQ['ship']}), n as (select a.seq_id, a.idx, median(b.y) as m from s a join s b on a.seq_id = b.seq_id and b.idx between a.idx - 10 and a.idx + 10 group by 1, 2) select n.seq_id, n.idx, round(greatest(1.4826 * median(abs(b.y - m)), 1e-3), 6) as mad from n join s b on n.seq_id = b.seq_id and b.idx between n.idx - 10 and n.idx + 10 group by n.seq_id, n.idx")
def rolling_mad(spark, sf):
    return rounded(src.rolling_mad(sequence(spark, sf, "ship")))


@query(f"with s as ({SEQ['ship']}), r as (select seq_id, idx, ln(y) - ln(lag(y) over (partition by seq_id order by idx)) as r from s) select seq_id, idx - 1 as idx, round(ln(r * r + 1e-12), 6) as y from r where r is not null")
def log_squared_change(spark, sf):
    return rounded(src.log_squared_change(sequence(spark, sf, "ship")).select("seq_id", "idx", "y"))


@query(f"with s as ({SEQ['ship']}), d as (select seq_id, y - lag(y) over (partition by seq_id order by idx) as d from s), m as (select seq_id, median(d) as m from d where d is not null group by 1) select d.seq_id, round(greatest(pow(1.4826 * median(abs(d - m)), 2) / 2, 1e-6), 6) as sigma2 from d join m using (seq_id) where d is not null group by 1")
def robust_sigma(spark, sf):
    from ..operators import metrics

    return rounded(metrics.robust_variance(sequence(spark, sf, "ship")))


@query(f"select seq_id, cast((idx - 1) // 4 + 1 as bigint) as idx, round(y, 6) as y from ({SEQ['ship']}) where (idx - 1) % 4 = 0")
def stride_subsample(spark, sf):
    return rounded(src.subsample(sequence(spark, sf, "ship"), 4).select("seq_id", "idx", "y"))


@query(f"select seq_id, sha256(string_agg(idx || ':' || printf('%.9f', y), ',' order by idx)) as sha256 from ({SEQ['ship']}) group by seq_id")
def content_hash(spark, sf):
    return src.content_hash(sequence(spark, sf, "ship"))


@query(f"select seq_id, count(*) as n, 0::bigint as n_not_finite, 0::bigint as n_negative_weight, 0::bigint as n_unordered, cast(max(idx) - count(*) as bigint) as n_gaps from ({SEQ['values']}) group by 1")
def input_violations(spark, sf):
    return rounded(src.violations(sequence(spark, sf, "values")))


# ---- hyperparameters -------------------------------------------------------------------------------------------------

_G = "with s as (select *, lead(y) over (partition by seq_id order by idx) as y2, (w + lead(w) over (partition by seq_id order by idx)) / 2 as d from ({0})), m as (select seq_id, sum(w * y) / sum(w) as nu from s group by 1) select seq_id, round(min(nu), 6) as nu, round(greatest({1}, 1e-12), 6) as rho2, round(greatest(sum(d * pow(y2 - y, 2)) / (2 * greatest(sum(d), 1)), 1e-12), 6) as sigma2 from s join m using (seq_id) group by 1"
_BETA = """with s as (select *, {p} as p, {wt} as wt from ({seq})), m as (select seq_id, sum(wt * p) / sum(wt) as mu, count(*) as n{phi} from s group by 1),
t as (select seq_id, min(mu) as mu, min(n) as n, sum(w * pow(p - mu, 2)) / sum(w) as v, sum(w * ({noise})) / sum(w) as noise from s join m using (seq_id) group by 1),
u as (select *, greatest({low}, mu * (1 - mu) / greatest(case when n > 1 then v else 1e-4 end - noise, {floor}) - 1) as tau from t)
select seq_id, round(greatest(mu * tau, 1e-12), 6) as alpha, round(greatest((1 - mu) * tau, 1e-12), 6) as beta from u"""
E1 = "mu * (1 - mu)"


@query(_G.format(SEQ["values"], "abs(sum(d * (y - nu) * (y2 - nu)) / greatest(sum(d), 1))"))
def gauss_hyper_cov(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "values"), "gaussian"))


@query(_G.format(SEQ["values"], "sum(w * pow(y - nu, 2)) / sum(w)"))
def gauss_hyper_var(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "values"), "gaussian", "var"))


@query(f"with s as ({SEQ['events']}), m as (select seq_id, sum(y) / sum(w) as m, count(*) as n from s group by 1), t as (select seq_id, min(m) as m, min(n) as n, sum(w * pow(y / w - m, 2)) / sum(w) as v from s join m using (seq_id) group by 1), u as (select *, case when v > m + 1e-12 then greatest(1e-8, m * m / (v - m)) else 1e6 end as alpha from t) select seq_id, round(alpha, 6) as alpha, round(greatest(1e-8, alpha / m), 6) as beta from u")
def poisson_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "events"), "poisson"))


@query(_BETA.format(p="y / n_trials", wt="w * n_trials", seq=SEQ["orders"], phi="", noise=f"{E1} / n_trials", low="1e-8", floor="1e-12"))
def binomial_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "orders"), "binomial"))


@query(_BETA.format(p="y", wt="w", seq=SEQ["labels"], phi="", noise=E1, low="1e-8", floor="1e-12"))
def bernoulli_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "labels"), "bernoulli"))


@query(_BETA.format(p="y", wt="w", seq=SEQ["discount"], phi="", noise=f"{E1} / 20", low="1e-8", floor="1e-12"))
def beta_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "discount"), "beta"))


@query(_BETA.format(p="1.0 / (1 + greatest(y, 0) + 1e-9)", wt="w", seq=SEQ["events"], phi="", noise="0", low="1e-6", floor="1e-9"))
def negbin_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "events"), "negbin"), 4)


ORACLE_4 = _BETA.replace(", 6)", ", 4)")
from .registry import ORACLES as _O  # noqa: E402

_O["negbin_hyper"] = ORACLE_4.format(p="1.0 / (1 + greatest(y, 0) + 1e-9)", wt="w", seq=SEQ["events"], phi="", noise="0", low="1e-6", floor="1e-9")


@query(_BETA.format(p="y", wt="w", seq=SEQ["discount"], phi=", avg(phi) as mphi", noise=f"{E1} / (mphi + 1)", low="1e-8", floor="1e-12"))
def beta_obs_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "discount"), "beta_obs"))


@query(f"with s as (select *, greatest(1e-3, least(1 - 1e-3, y / n_trials)) as c from ({SEQ['orders']})), z as (select *, ln(c / (1 - c)) as z from s), m as (select seq_id, sum(w * z) / sum(w) as nu from z group by 1) select seq_id, round(min(nu), 6) as nu, round(greatest(sum(w * pow(z - nu, 2)) / sum(w), 1e-6), 6) as rho2 from z join m using (seq_id) group by 1")
def logit_hyper(spark, sf):
    return rounded(families.hyper(sequence(spark, sf, "orders"), "logistic_normal"))


# ---- blocks ----------------------------------------------------------------------------------------------------------

_CASES = {
    "gauss_blocks": ("values", "gaussian"), "poisson_blocks": ("events", "poisson"), "binomial_blocks": ("orders", "binomial"),
    "bernoulli_blocks": ("labels", "bernoulli"), "beta_blocks": ("discount", "beta"), "negbin_blocks": ("events", "negbin"),
}


def _register_blocks():
    for name, (data, fam) in _CASES.items():

        def run(spark, sf, data=data, fam=fam):
            if data == "labels":  # one row per document, the other sequences are bounded by the calendar
                seq = sequence(spark, sf, data)
                rows = families.spread(finite_rounded(families.gathered(seq, fam, given(seq, fam))))  # rounded once a group
                return rows.withColumns({c: F.col(c).cast("long") for c in "ij"})
            return rounded(block_table(sequence(spark, sf, data), fam))

        run.__name__ = name
        query(sql_blocks(SEQ[data], fam, GIVEN[fam]) + " select seq_id, i, j, round(s, 6) as log_a0, round(a1, 6) as a1 from blk")(run)


_register_blocks()
_POWER = SEQ["values"].replace("1.0::double as a", "0.5::double as a")
_MASK = f"select * replace (case when idx % 5 = 0 then 0.0 else 1.0 end as a) from ({SEQ['values']})"
_EXPOSE = f"select * replace ((1 + idx % 3)::double as w) from ({SEQ['events']})"


@query(sql_blocks(_POWER, "gaussian", GIVEN["gaussian"]) + " select seq_id, i, j, round(s, 6) as log_a0, round(a1, 6) as a1 from blk")
def gauss_blocks_power(spark, sf):
    return rounded(block_table(sequence(spark, sf, "values").withColumn("a", F.lit(0.5)), "gaussian"))


@query(sql_blocks(_MASK, "gaussian", GIVEN["gaussian"]) + " select seq_id, i, j, round(s, 6) as log_a0, round(a1, 6) as a1 from blk")
def gauss_blocks_masked(spark, sf):
    s = sequence(spark, sf, "values").withColumn("observed", F.col("idx") % 5 != 0)
    s = s.withColumn("y", F.when(F.col("observed"), F.col("y")).otherwise(F.lit(float("nan"))))
    return rounded(block_table(src.complete(s), "gaussian"))


@query(sql_blocks(_EXPOSE, "poisson", GIVEN["poisson"]) + " select seq_id, i, j, round(s, 6) as log_a0, round(a1, 6) as a1 from blk")
def poisson_exposure_blocks(spark, sf):
    return rounded(block_table(sequence(spark, sf, "events").withColumn("w", (F.col("idx") % 3 + 1).cast("double")), "poisson"))


@query(sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"]) + f" select seq_id, pos, {', '.join(f'round(p_{k}, 6) as p_{k}' for k in FAMILY['poisson'][0])} from pre")
def prefix_sums(spark, sf):
    return rounded(families.prefix(sequence(spark, sf, "events"), "poisson"))


@query(sql_blocks(SEQ["ship"], "poisson", GIVEN["poisson"]) + " select seq_id, i, j, round(s, 6) as log_a0 from blk where j - i between 5 and 12")
def length_bounded_blocks(spark, sf):
    return rounded(block_table(sequence(spark, sf, "ship"), "poisson", min_len=5, max_len=12).drop("a1"))


# ---- priors ----------------------------------------------------------------------------------------------------------

_EV = sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"])
_U = "u as (select seq_id, idx as pos, idx + 0.5 as u from seq union all select distinct seq_id, 0, 0.5 from seq)"


_LENGTHS = f"n as (select seq_id, least(8, max(idx)) as most, max(idx) as n from ({SEQ['ship']}) group by 1)"


def _lengths(spark, sf):
    return sequence(spark, sf, "ship").groupBy("seq_id").agg(F.max("idx").cast("long").alias("n"))


@query(f"with {_LENGTHS}, p as (select * from (values ('geometric_0.5', 0.5::double), ('geometric_0.1', 0.1), ('uniform', 1.0)) t(prior, rate)), r as (select seq_id, prior, k, pow(rate, k - 1) as p from n, p, range(1, 9) t(k) where k <= most) select seq_id, prior, k, round(ln(p / sum(p) over (partition by seq_id, prior)), 6) as log_p from r")
def prior_count(spark, sf):
    """Count priors over as many numbers of segments as each sequence allows, 8 at most."""
    most = _lengths(spark, sf).withColumn("most", F.least(F.lit(8), "n"))
    rows = [prior.count_prior_table(spark, p, m).select(F.lit(p).alias("prior"), F.lit(m).alias("most"), "k", "log_p") for p in ("geometric_0.5", "geometric_0.1", "uniform") for m in range(1, 9)]
    table = rows[0]
    for r in rows[1:]:
        table = table.unionByName(r)
    return rounded(most.join(table, "most").select("seq_id", "prior", "k", "log_p"))


@query(_EV + f", {_U} select b.seq_id, b.i, b.j, round(1.5 * ln((uj.u - ui.u) / 2.0), 6) as log_g from blk b join u ui on ui.seq_id = b.seq_id and ui.pos = b.i join u uj on uj.seq_id = b.seq_id and uj.pos = b.j")
def prior_cohesion(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(cohesion="span", power=1.5, scale=2.0)).select("seq_id", "i", "j", "log_g"))


@query(_EV + " select b.seq_id, i, j, round(case when j < n then 0.3 + ln(1 - exp(-0.3)) else 0 end, 6) as log_g from blk b join len using (seq_id)")
def prior_hazard_poisson(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(hazard="poisson", rate=0.3)).select("seq_id", "i", "j", "log_g"))


@query(_EV + " select b.seq_id, i, j, round(case when j < n and j % 7 = 0 then ln(3.0) else 0 end, 6) as log_g from blk b join len using (seq_id) where j = n or j % 7 <> 3")
def prior_hazard_explicit(spark, sf):
    s = sequence(spark, sf, "events")
    side = spark.range(1, 200).select(F.col("id").cast("int").alias("pos"), F.when(F.col("id") % 7 == 0, 3.0).when(F.col("id") % 7 == 3, 0.0).otherwise(1.0).alias("factor"))
    return rounded(prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(boundaries=side)).select("seq_id", "i", "j", "log_g"))


@query(_EV + " select seq_id, i, j, round(s, 6) as log_a0 from blk where j - i >= 6")
def prior_min_length(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(min_len=6)).select("seq_id", "i", "j", "log_a0"))


@query(f"with {_LENGTHS} select seq_id, n, k, round(lgamma(n) - lgamma(k) - lgamma(n - k + 1), 6) as log_c from n, range(1, 9) b(k) where k <= n")
def log_ck_uniform(spark, sf):
    k = _lengths(spark, sf).select("seq_id", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(8), F.col("n").cast("int")))).alias("k"))
    return rounded(k.select("seq_id", "n", "k", prior.log_ck_uniform(F.col("n"), F.col("k")).alias("log_c")))


_LEN = _EV + ", adm as (select seq_id, i, j, 0.0 as s from blk where j - i >= 4), " + sql_forward(4, "adm")


@query(_LEN + " select f.seq_id, k, round(l, 6) as log_c from fwd f join len on f.seq_id = len.seq_id and f.j = len.n")
def log_ck_length(spark, sf):
    s = sequence(spark, sf, "events")
    b = prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(min_len=4))
    return rounded(segment.fit_blocks(b.withColumn("log_g", F.lit(0.0)).withColumn("log_a0", F.lit(0.0)), 4, "uniform", curves=False).rows.select("seq_id", F.posexplode("log_left_n").alias("k", "log_c")).select("seq_id", (F.col("k") + 1).alias("k"), "log_c"))


# ---- posteriors ------------------------------------------------------------------------------------------------------

_FW = _EV + ", " + sql_forward(4)
_FB = _FW + ", " + sql_backward(4)
_PO = _FB + ", " + sql_posterior()
_MAP = "kmap as (select seq_id, arg_max(k, log_post) as k from post group by 1)"
_MARG = "marg as (select f.seq_id, f.j as pos, f.k + b.k as k, sum(exp(f.l + b.l - t.l)) as p from fwd f join bwd b on f.seq_id = b.seq_id and f.j = b.i join len on len.seq_id = f.seq_id join fwd t on t.seq_id = f.seq_id and t.j = len.n and t.k = f.k + b.k group by 1, 2, 3)"


def _fit(spark, sf, data="events", fam="poisson", k_max=4, **kw):
    s = sequence(spark, sf, data)
    return segment.segment(s, fam, k_max, given(s, fam), **kw)


@query(_FW + " select f.seq_id, k, round(l, 6) as l from fwd f join len on len.seq_id = f.seq_id and f.j = len.n")
def forward_table(spark, sf):
    r = _fit(spark, sf, curves=False).rows
    return rounded(r.select("seq_id", F.posexplode("log_left_n").alias("k", "l")).select("seq_id", (F.col("k") + 1).alias("k"), "l"))


@query(_FW + " select f.seq_id, k, round(l, 6) as l from fwd f join len on len.seq_id = f.seq_id and f.j = len.n")
def forward_from_blocks(spark, sf):
    """The same table from the distributed block table instead of the fused kernel."""
    r = segment.fit_blocks(block_table(sequence(spark, sf, "events"), "poisson"), 4, curves=False).rows
    return rounded(r.select("seq_id", F.posexplode("log_left_n").alias("k", "l")).select("seq_id", (F.col("k") + 1).alias("k"), "l"))


@query(_PO + " select seq_id, k, round(log_c, 6) as log_c, round(log_py_k, 6) as log_py_k, round(log_post, 6) as log_post, round(exp(log_post), 6) as post from post")
def posterior_k(spark, sf):
    return rounded(_fit(spark, sf, curves=False).posterior_k)


@query(_PO + ", " + _MAP + " select distinct p.seq_id, round(z, 6) as log_evidence, kmap.k as k_map from post p join kmap using (seq_id)")
def log_evidence(spark, sf):
    return rounded(_fit(spark, sf, curves=False).summary.select("seq_id", "log_evidence", "k_map"))


@query(_PO + ", " + _MARG + " select seq_id, k as k_map, pos, round(p, 6) as p from marg where k = 3")
def boundary_marginals(spark, sf):
    return rounded(_fit(spark, sf, curves=False, k=3).boundary_marginal.select("seq_id", "k_map", "pos", "p").where(F.round("p", 6) >= 0))


@query(_PO + ", " + _MARG + " select m.seq_id, pos, round(sum(exp(log_post) * p), 6) as p from marg m join post using (seq_id, k) where k <= 4 group by 1, 2")
def boundary_marginals_mixed(spark, sf):
    return rounded(_fit(spark, sf, curves=False).boundary_marginal_mixed)


@query(_FB + " select f.seq_id, 3::bigint as k_map, f.k as boundary, f.j as pos, round(exp(f.l + b.l - t.l), 6) as p from fwd f join bwd b on f.seq_id = b.seq_id and f.j = b.i and f.k + b.k = 3 join len on len.seq_id = f.seq_id join fwd t on t.seq_id = f.seq_id and t.j = len.n and t.k = 3")
def boundary_location(spark, sf):
    return rounded(_fit(spark, sf, curves=False, k=3).boundary_location)


_PATHS = _EV + """, paths as (select a.seq_id, a.j as t1, b.j as t2, a.s + b.s + c.s as v, a.a1 as m1, b.a1 as m2, c.a1 as m3
  from blk a join blk b on a.seq_id = b.seq_id and b.i = a.j join blk c on c.seq_id = a.seq_id and c.i = b.j join len on len.seq_id = a.seq_id where a.i = 0 and c.j = len.n),
best as (select distinct on (seq_id) * from paths order by seq_id, v desc, t2, t1)"""


@query(_PATHS + " select seq_id, 1::bigint as q, 0::bigint as i, t1 as j, round(m1, 6) as mean from best union all select seq_id, 2, t1, t2, round(m2, 6) from best union all select seq_id, 3, t2, n, round(m3, 6) from best join len using (seq_id)")
def map_segments(spark, sf):
    return rounded(_fit(spark, sf, curves=False, k=3).segment)


@query(_PATHS + " select seq_id, round(v, 6) as log_joint_map from best")
def map_score(spark, sf):
    return rounded(_fit(spark, sf, curves=False, k=3).summary.select("seq_id", "log_joint_map"))


@query(_PATHS + " select seq_id, idx, round(case when idx <= t1 then m1 when idx <= t2 then m2 else m3 end, 6) as mean from seq join best using (seq_id)")
def map_curve(spark, sf):
    return rounded(_fit(spark, sf, curves=False, k=3).map_curve)


@query(_PATHS + ", z as (select *, max(v) over (partition by seq_id) as m from paths) select seq_id, round(m + ln(sum(exp(v - m))), 6) as log_sum, count(*) as n_paths from z group by seq_id, m")
def enumerate_k3(spark, sf):
    """All partitions into three blocks against the recursion (sum and count)."""
    r = _fit(spark, sf, curves=False, k=3).rows
    return rounded(r.select("seq_id", F.element_at("log_left_n", 3).alias("log_sum"), ((F.col("n") - 1) * (F.col("n") - 2) / 2).cast("long").alias("n_paths")))


@query(_FB + ", " + _MARG + " select seq_id, pos, round(p, 6) as p from (select *, row_number() over (partition by seq_id order by p desc, pos) as rk from marg where k = 3) where rk < 3")
def marginal_modes(spark, sf):
    return rounded(_fit(spark, sf, curves=False, k=3).modes)


_CURVE = _PATHS + ", z as (select *, exp(v - max(v) over (partition by seq_id)) as e from paths), w as (select *, e / sum(e) over (partition by seq_id) as p from z)"


@query(_CURVE + " select s.seq_id, s.idx, round(sum(p * case when idx <= t1 then m1 when idx <= t2 then m2 else m3 end), 6) as bayes_fixed from seq s join w using (seq_id) group by 1, 2")
def bayes_curve_fixed(spark, sf):
    return rounded(_fit(spark, sf, k=3).curve.select("seq_id", "idx", "bayes_fixed"))


_K12 = _EV + ", " + sql_forward(2) + ", " + sql_posterior(k_max=2) + """, two as (select a.seq_id, a.j as t, a.s + b.s as v, a.a1 as m1, b.a1 as m2 from blk a join blk b on a.seq_id = b.seq_id and b.i = a.j join len on len.seq_id = a.seq_id where a.i = 0 and b.j = len.n),
w as (select *, exp(v - max(v) over (partition by seq_id)) as e from two), c2 as (select s.seq_id, s.idx, sum(e * case when idx <= t then m1 else m2 end) / sum(e) as c from seq s join w using (seq_id) group by 1, 2), c1 as (select b.seq_id, b.a1 as c from blk b join len on b.seq_id = len.seq_id and i = 0 and j = n)"""


@query(_K12 + " select c2.seq_id, c2.idx, round(exp(p1.log_post) * c1.c + exp(p2.log_post) * c2.c, 6) as bayes_mixed from c2 join c1 using (seq_id) join post p1 on p1.seq_id = c2.seq_id and p1.k = 1 join post p2 on p2.seq_id = c2.seq_id and p2.k = 2")
def bayes_curve_mixed(spark, sf):
    return rounded(_fit(spark, sf, k_max=2).curve.select("seq_id", "idx", "bayes_mixed"))


_HAZ = _EV.replace("with recursive seq", "with recursive seq") + ", tilt as (select b.seq_id, i, j, s + ln(j - i) as s from blk b), gee as (select seq_id, i, j, ln(j - i) as s from blk), " + sql_forward(3, "tilt")


@query(_HAZ + ", " + sql_forward(3, "gee", "g", "gwd") + " select f.seq_id, f.k, round(g.l, 6) as log_c, round(f.l - g.l, 6) as log_py_k from fwd f join gwd g using (seq_id, k, j) join len on len.seq_id = f.seq_id and f.j = len.n")
def posterior_k_cohesion(spark, sf):
    """Evidence per k under a length cohesion, with its own normaliser."""
    s = sequence(spark, sf, "events")
    b = prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(cohesion="length", power=1.0))
    return rounded(segment.fit_blocks(b, 3, curves=False).posterior_k.select("seq_id", "k", "log_c", "log_py_k"))


_SPAN = _EV + f", {_U}, gee as (select b.seq_id, b.i, b.j, ln(1 + uj.u - ui.u) - 0.2 * (uj.u - ui.u) as s from blk b join u ui on ui.seq_id = b.seq_id and ui.pos = b.i join u uj on uj.seq_id = b.seq_id and uj.pos = b.j where uj.u - ui.u <= 21), tilt as (select b.seq_id, b.i, b.j, b.s + g.s as s from blk b join gee g using (seq_id, i, j)), " + sql_forward(3, "tilt")
_OWN_C = ", " + sql_forward(3, "gee", "g", "gwd") + " select f.seq_id, f.k, round(g.l, 6) as log_c, round(f.l - g.l, 6) as log_py_k from fwd f join gwd g using (seq_id, k, j) join len on len.seq_id = f.seq_id and f.j = len.n"


def own_span(x, ns):
    """A prior of the caller's own: short and middling blocks, none beyond 21 on the axis."""
    return ns.where(x <= 21.0, ns.ln(1.0 + x) - 0.2 * x, float("-inf"))


@query(_SPAN + _OWN_C)
def span_prior_blocks(spark, sf):
    """Evidence per k under a function of the span, by a block table."""
    s = sequence(spark, sf, "events")
    b = prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(span=own_span))
    return rounded(segment.fit_blocks(b, 3, curves=False).posterior_k.where("log_c > double('-inf')").select("seq_id", "k", "log_c", "log_py_k"))


@query(_SPAN + _OWN_C)
def span_prior_kernel(spark, sf):
    """The same function in the kernel that makes no block table."""
    return rounded(_fit(spark, sf, k_max=3, curves=False, span=own_span, on_axis=True).posterior_k.where("log_c > double('-inf')").select("seq_id", "k", "log_c", "log_py_k"))


@query(_PO + """, new as (select seq_id, k, log_py_k + ln(1.0 / k / (25.0 / 12)) as v, ln(pow(0.5, k - 1) / 1.875) as log_p from post), z as (select *, max(v) over (partition by seq_id) as m from new)
  select seq_id, k, round(log_p, 6) as log_p, round(v - m - ln(sum(exp(v - m)) over (partition by seq_id)), 6) as log_post, round(m + ln(sum(exp(v - m)) over (partition by seq_id)), 6) as log_evidence from z""")
def prior_exchange(spark, sf):
    """A fit's own count prior, recovered from it, and its posterior under another one, without a new fit."""
    fit = _fit(spark, sf, curves=False)
    return rounded(fit.under(lambda k: 1.0 / k).join(fit.count_prior, ["seq_id", "k"]).select("seq_id", "k", "log_p", "log_post", "log_evidence"))


@query(sql_blocks(SEQ["events"], "poisson", EB["poisson"]) + ", " + sql_forward(6) + ", " + sql_posterior(k_max=6) + ", " + sql_best(6) + ", " + PATH + " select p.seq_id, p.q, p.i, p.j, round(a1, 6) as mean, kmap.k as k_map, round(z, 6) as log_evidence, round(exp(e.log_post), 6) as p_k_max from path p join blk b using (seq_id, i, j) join kmap using (seq_id) join post e on e.seq_id = p.seq_id and e.k = 6")
def segment_events_poisson(spark, sf):
    """Flagship: empirical-Bayes Poisson segmentation of the daily counts of each event type."""
    fit = segment.segment(sequence(spark, sf, "events"), "poisson", 6)
    return rounded(fit.segment.join(fit.summary, "seq_id").select("seq_id", "q", "i", "j", "mean", "k_map", "log_evidence", "p_k_max"))


_USERS = "select seq_id, cast(row_number() over (partition by seq_id order by ts, event_id) as bigint) as idx, ln(value) as y, 1.0::double as w, 1.0::double as a from (select user_id::varchar as seq_id, ts, event_id, value from events where value > 0)"


@query(sql_blocks(_USERS, "gaussian", EB["gaussian"]) + ", " + sql_forward(4) + ", " + sql_posterior() + ", " + sql_best(4) + ", " + PATH + " select p.seq_id, p.q, p.i, p.j, round(a1, 6) as mean from path p join blk b using (seq_id, i, j)")
def segment_users_irregular(spark, sf):
    """One Gaussian segmentation per user over irregular times: the throughput query."""
    return rounded(segment.segment(src.complete(src.user_values(load(spark, sf, "events"))), "gaussian", 4, curves=False).segment)


@query()
def segment_ship_daily(spark, sf):
    """Long sequences: daily shipments per return flag, about 2,500 days each, up to 20 segments."""
    from ..sources.sequences import bucketed

    days = bucketed(load(spark, sf, "lineitem"), F.col("l_returnflag"), F.date_trunc("day", "l_shipdate"), F.count(F.lit(1)).cast("double"))
    return segment.segment(src.complete(days), "poisson", 20, curves=False).segment


def _clock(spark, sf, minutes: int):
    """Counts of all events in each so many minutes that has any, as one sequence."""
    from ..sources.sequences import bucketed

    at = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / (60 * minutes)) * 60 * minutes)
    return src.complete(bucketed(load(spark, sf, "events"), F.lit("all"), at, F.count(F.lit(1)).cast("double")))


@query(
    sql_blocks(SEQ["events"].replace("event_type", "'all'").replace("date_trunc('day', ts)", "time_bucket(interval 30 minutes, ts)"), "poisson", EB["poisson"])
    + ", " + sql_forward(3) + ", " + sql_posterior(k_max=3) + ", " + sql_best(3) + ", " + PATH
    + " select p.seq_id, p.q, p.i, p.j, round(a1, 6) as mean, kmap.k as k_map, round(z, 6) as log_evidence from path p join blk b using (seq_id, i, j) join kmap using (seq_id) join post on post.seq_id = p.seq_id and post.k = kmap.k"
)
def segment_half_hours(spark, sf):
    """A fit over tiles (every length goes that way here) under SQL."""
    fit = segment.segment(_clock(spark, sf, 30), "poisson", 3, curves=False, dense_rows=0)
    return rounded(fit.segment.join(fit.summary, "seq_id").select("seq_id", "q", "i", "j", "mean", "k_map", "log_evidence"))


@query()
def segment_five_minutes(spark, sf):
    """One long sequence, up to 8,640 rows: beyond dense tables, exact over tiles."""
    return rounded(segment.segment(_clock(spark, sf, 5), "poisson", 6, curves=False).segment)
