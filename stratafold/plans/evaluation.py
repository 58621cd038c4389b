"""Queries over metrics, diagnostics and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines, diagnose, metrics, quadrature, segment, splits
from .core import block_table, given, sequence
from .registry import PATH, PHI, SEQ, query, rounded, sql_backward, sql_best, sql_blocks, sql_forward, sql_posterior
from .core import GIVEN

_EV = sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"])


def _fit(spark, sf, k_max=4, **kw):
    s = sequence(spark, sf, "events")
    return segment.segment(s, "poisson", k_max, given(s, "poisson"), curves=False, **kw)


_CHECKS = _EV + ", " + sql_forward(4) + ", " + sql_backward(4) + ", " + sql_posterior() + ", " + sql_best(4) + """,
kmap as (select seq_id, arg_max(k, log_post) as k from post group by 1),
ends as (select f.seq_id, f.k, f.l, r.l as r, m.v from fwd f join len on len.seq_id = f.seq_id and f.j = n join kmap on kmap.seq_id = f.seq_id and kmap.k = f.k join bwd r on r.seq_id = f.seq_id and r.k = f.k and r.i = 0 join best m on m.seq_id = f.seq_id and m.k = f.k and m.j = n),
sums as (select e.seq_id, e.k, coalesce(sum(exp(f.l + b.l - e.l)), 0) as m from ends e left join fwd f on f.seq_id = e.seq_id and f.k < e.k left join bwd b on b.seq_id = f.seq_id and b.i = f.j and b.k = e.k - f.k where f.k is null or b.k is not null group by 1, 2)
select seq_id, 'posterior_sums_to_one' as name, abs(sum(exp(log_post)) - 1) <= 1e-9 as passed from post group by 1
union all select seq_id, 'left_equals_right', abs(l - r) <= 1e-6 from ends union all select seq_id, 'map_within_sum', v - l <= 1e-9 from ends
union all select seq_id, 'marginals_sum_to_k_minus_1', abs(m - (k - 1)) <= 1e-6 from sums"""


@query(_CHECKS)
def dp_diagnostics(spark, sf):
    return diagnose.invariants(_fit(spark, sf)).select("seq_id", "name", "passed")


@query(_EV + ", " + sql_best(3) + ", three as (select a.seq_id, max(a.s + b.s + c.s) as v from blk a join blk b on a.seq_id = b.seq_id and b.i = a.j join blk c on c.seq_id = a.seq_id and c.i = b.j join len on len.seq_id = a.seq_id and c.j = n where a.i = 0 group by 1) select t.seq_id, round(abs(t.v - m.v), 6) as gap from three t join len using (seq_id) join best m on m.seq_id = t.seq_id and m.k = 3 and m.j = n")
def map_score_check(spark, sf):
    return rounded(diagnose.map_score_check(_fit(spark, sf, k=3), block_table(sequence(spark, sf, "events"), "poisson")))


@query()
def diagnostic_report(spark, sf):
    return diagnose.report(diagnose.invariants(_fit(spark, sf)))


def sql_variant(prior: str, power: float = 0.0, k_max: int = 4) -> str:
    """One query of all that a comparison of fits needs, under a count prior and a power of the block length: rows
    (seq_id, kind, key, v) with p(k), mixed boundary marginals and MAP boundaries."""
    b, log_c, own = "blk", "(lgamma(n) - lgamma(k) - lgamma(n - k + 1))", ""
    if power:
        b, log_c = "tilt", "(select g.l from gwd g where g.seq_id = f.seq_id and g.k = f.k and g.j = f.j)"
        own = f", tilt as (select seq_id, i, j, s + {power} * ln(j - i) as s from blk), gee as (select seq_id, i, j, {power} * ln(j - i) as s from blk), " + sql_forward(k_max, "gee", "g", "gwd")
    return (
        "(" + _EV + own + ", " + sql_forward(k_max, b) + ", " + sql_backward(k_max, b) + ", " + sql_posterior(prior, k_max, log_c) + ", " + sql_best(k_max, b) + ", " + PATH + f""",
        marg as (select f.seq_id, f.j as pos, f.k + b.k as k, sum(exp(f.l + b.l - t.l)) as p from fwd f join bwd b on f.seq_id = b.seq_id and f.j = b.i join len on len.seq_id = f.seq_id join fwd t on t.seq_id = f.seq_id and t.j = len.n and t.k = f.k + b.k where f.k + b.k <= {k_max} and f.j < len.n group by 1, 2, 3)
        select seq_id, 'k' as kind, k as key, exp(log_post) as v from post union all select seq_id, 'm', pos, sum(exp(log_post) * p) from marg join post using (seq_id, k) group by 1, 3
        union all select p.seq_id, 'b', p.j, 1.0 from path p join len using (seq_id) where p.j < n)"""
    )


_VARIANTS = {"uniform": ("1.0", 0.0), "geometric_0.8": ("pow(0.8, k - 1)", 0.0), "inverse": ("1.0 / k", 0.0), "length_0.5": ("pow(0.5, k - 1)", 0.5), "length_1.0": ("pow(0.5, k - 1)", 1.0)}
_SENSITIVE = " union all ".join(
    f"""select '{name}' as variant, seq_id, sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) filter (kind = 'k') as l1_k, sum(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) filter (kind = 'm') as l1_marginal,
    max(abs(coalesce(a.v, 0) - coalesce(b.v, 0))) filter (kind = 'm') as max_marginal, case when count(*) filter (kind = 'b') = 0 then 1.0 else count(*) filter (kind = 'b' and a.v = b.v) / count(*) filter (kind = 'b') end as jaccard
    from {sql_variant("pow(0.5, k - 1)")} a full join {sql_variant(*v)} b using (seq_id, kind, key) group by seq_id"""
    for name, v in _VARIANTS.items()
)


@query(f"select variant, seq_id, round(l1_k, 6) as l1_k, round(l1_marginal, 6) as l1_marginal, round(max_marginal, 6) as max_marginal, round(jaccard, 6) as jaccard from ({_SENSITIVE})")
def prior_sensitivity(spark, sf):
    return rounded(diagnose.prior_sensitivity(block_table(sequence(spark, sf, "events"), "poisson"), 4))


_NB = sql_blocks(SEQ["events"], "negbin", GIVEN["negbin"])
_ERR = sql_blocks(SEQ["values"], "gaussian", GIVEN["gaussian"]) + ", oth as (select seq_id, i, j, s + 0.01 * (j - i) as s from blk), d as (select b.seq_id, abs(b.s - o.s) as d from blk b join oth o using (seq_id, i, j) join len using (seq_id) where case when b.i > 0 then 1 else 0 end + 1 + case when b.j < n then 1 else 0 end <= 3), e as (select seq_id, 0::bigint as mismatched, max(d) as max_error, median(d) as median_error, avg(d) as mean_error from d group by 1)"


def _error(spark, sf):
    b = block_table(sequence(spark, sf, "values"), "gaussian")
    return diagnose.block_error(b, b.withColumn("log_a0", F.col("log_a0") + 0.01 * (F.col("j") - F.col("i"))), 3)


@query(_ERR + " select seq_id, mismatched, round(max_error, 6) as max_error, round(median_error, 6) as median_error, round(mean_error, 6) as mean_error from e")
def block_error_bounds(spark, sf):
    return rounded(_error(spark, sf))


@query(_ERR + " select seq_id, round(3 * max_error, 6) as eta, round(6 * max_error, 6) as log_odds, round(exp(-6 * max_error), 6) as ratio_low, round(exp(6 * max_error), 6) as ratio_high, round(least(1.0, exp(6 * max_error) - 1), 6) as tv from e")
def tv_bound(spark, sf):
    return rounded(diagnose.bounds(_error(spark, sf), 3))


@query(_EV + " select b.seq_id, count(*) as n_rows_rule, count(*) filter (case when i > 0 then 1 else 0 end + 1 + case when j < n then 1 else 0 end <= 2) as n_blocks_rule from (select b.*, n from blk b join len using (seq_id)) b where i + n - j + 1 <= 6 group by 1")
def reachable_blocks(spark, sf):
    b = block_table(sequence(spark, sf, "events"), "poisson")
    r = diagnose.reachable(b, 6)
    m = r.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_rows_rule"))
    k = r.where((F.col("i") > 0).cast("int") + 1 + (F.col("j") < F.col("n")).cast("int") <= 2)
    return rounded(m.join(k.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_blocks_rule")), "seq_id"))


# ---- metrics ---------------------------------------------------------------------------------------------------------


def _marked(spark, sf):
    """Each month's step of the shipment sequences as boundaries: predicted at multiples of 9, reference of 10."""
    s = sequence(spark, sf, "ship").select("seq_id", F.col("idx").cast("double").alias("pos"))
    p = s.where("pos % 9 = 0").withColumn("kind", F.lit("predicted"))
    return p.unionByName(s.where("pos % 10 = 0").withColumn("kind", F.lit("reference")))


@query(f"with s as ({SEQ['ship']}), p as (select seq_id, idx from s where idx % 9 = 0), r as (select seq_id, idx from s where idx % 10 = 0), m as (select p.seq_id, count(*) as m from p join r using (seq_id, idx) group by 1), np as (select seq_id, count(*) as np from p group by 1), nr as (select seq_id, count(*) as nr from r group by 1) select np.seq_id, 0.0::double as tolerance, coalesce(m, 0) as matched, round(coalesce(m, 0) / np, 6) as precision, round(coalesce(m, 0) / nr, 6) as recall, round(case when coalesce(m, 0) > 0 then 2.0 * m / (np + nr) else 0 end, 6) as f1 from np join nr using (seq_id) left join m using (seq_id)")
def boundary_f1_exact(spark, sf):
    return rounded(metrics.boundary_scores(_marked(spark, sf), (0.0,)).drop("mae"))


@query()
def boundary_f1(spark, sf):
    return metrics.boundary_scores(_marked(spark, sf))


_MARG = _EV + ", " + sql_forward(3) + ", " + sql_backward(3) + ", marg as (select f.seq_id, f.j as pos, sum(exp(f.l + b.l - t.l)) as p from fwd f join bwd b on f.seq_id = b.seq_id and f.j = b.i and f.k + b.k = 3 join len on len.seq_id = f.seq_id join fwd t on t.seq_id = f.seq_id and t.j = len.n and t.k = 3 group by 1, 2), lab as (select m.seq_id, m.pos, least(1.0, p) as p, case when pos % 10 = 0 then 1.0 else 0.0 end as hit from marg m join len using (seq_id) where pos < n)"


def _probs(spark, sf):
    m = _fit(spark, sf, k=3).boundary_marginal.select("seq_id", "pos", F.least(F.lit(1.0), F.col("p")).alias("p"))
    return m, m.where("pos % 10 = 0").select("seq_id", "pos")


@query(_MARG + " select seq_id, round(avg(pow(p - hit, 2)), 6) as brier, round(avg(case when hit = 1 then ln(greatest(1e-12, least(1 - 1e-12, p))) else ln(1 - greatest(1e-12, least(1 - 1e-12, p))) end), 6) as log_score from lab group by 1")
def brier_logscore(spark, sf):
    return rounded(metrics.probability_scores(*_probs(spark, sf)))


@query(_MARG + ", r as (select *, row_number() over (order by p, seq_id, pos) as rn, count(*) over () as n from lab), b as (select least(cast(floor((rn - 1) / floor(n / 10)) as bigint), 9) as bin, p, hit from r) select bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(hit), 6) as rate from b group by 1")
def ece_bins(spark, sf):
    m, t = _probs(spark, sf)
    lab = m.join(t.withColumn("hit", F.lit(1.0)), ["seq_id", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    return rounded(metrics.calibration(lab))


@query(_MARG + ", r as (select *, row_number() over (order by p, seq_id, pos) as rn, count(*) over () as n from lab), b as (select least(cast(floor((rn - 1) / floor(n / 10)) as bigint), 9) as bin, p, hit from r), c as (select bin, count(*) as n, avg(p) as mp, avg(hit) as rate from b group by 1) select round(sum(n * abs(mp - rate)) / sum(n), 6) as ece from c")
def calibration_error(spark, sf):
    m, t = _probs(spark, sf)
    lab = m.join(t.withColumn("hit", F.lit(1.0)), ["seq_id", "pos"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    return rounded(metrics.expected_calibration_error(metrics.calibration(lab)))


@query(f"with s as ({SEQ['labels']}), u as (select seq_id, (idx - 0.3 * y) / (1.0 + count(*) over (partition by seq_id)) as pit from s), r as (select *, row_number() over (partition by seq_id order by pit) as rn, count(*) over (partition by seq_id) as n from u) select seq_id, round(max(greatest(rn / n - pit, pit - (rn - 1) / n)), 6) as ks from r group by 1")
def ks_uniform(spark, sf):
    s = sequence(spark, sf, "labels")
    t = s.join(s.groupBy("seq_id").agg(F.max("idx").alias("n")), "seq_id").withColumn("pit", (F.col("idx") - 0.3 * F.col("y")) / (F.col("n") + 1.0))
    return rounded(metrics.ks_uniform(t))


@query(_EV + ", " + sql_forward(4) + ", " + sql_posterior() + ", o as (select seq_id, k, exp(log_post) as p, coalesce(sum(exp(log_post)) over (partition by seq_id order by log_post desc, k rows between unbounded preceding and 1 preceding), 0) as before from post) select seq_id, max(k) - min(k) as width, count(*) as size from o where before < 0.95 group by 1")
def k_credible_width(spark, sf):
    return rounded(metrics.k_width(_fit(spark, sf).posterior_k))


@query("with l as (select quality as truth, toxic as found from labels), c as (select truth, found, count(*) as n from l group by 1, 2), t as (select sum(n * (n - 1) / 2) as cells, sum(n) as total from c), a as (select sum(n * (n - 1) / 2) as a from (select sum(n) as n from c group by truth)), b as (select sum(n * (n - 1) / 2) as b from (select sum(n) as n from c group by found)) select round((cells - a * b / (total * (total - 1) / 2)) / ((a + b) / 2 - a * b / (total * (total - 1) / 2)), 6) as ari from t, a, b")
def adjusted_rand(spark, sf):
    from .registry import load

    return rounded(metrics.adjusted_rand(load(spark, sf, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("found"))))


@query("with c as (select l_linenumber::bigint as line, l_returnflag as t, l_suppkey % 2 as f, count(*) as n from lineitem group by 1, 2, 3), one as (select a.line, max(a.n + coalesce(b.n, 0)) as best from c a left join c b on a.line = b.line and a.t <> b.t and a.f <> b.f group by 1), n as (select line, sum(n) as n from c group by 1) select one.line, round(best / n, 6) as accuracy from one join n using (line)")
def permuted_accuracy(spark, sf):
    """How well a half of the suppliers tells return flags, under the best naming, per line number."""
    from .registry import load

    labels = load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("truth"), (F.col("l_suppkey") % 2).alias("found"))
    return rounded(metrics.permuted_accuracy(labels, ["line"]))


_BOOT = "b as (select seq_id, y, d, ('0x' || substr(md5(seq_id || ':' || idx || ':7:' || (d // 4)), 1 + 8 * (d % 4), 8))::bigint as u from s, range(0, 500) t(d)), w as (select seq_id, y, d, " + " + ".join(f"(u >= {c})::int" for c in metrics.POISSON_ONE) + " as w from b)"


@query(f"with s as ({SEQ['values']}), {_BOOT}, m as (select seq_id, d, sum(w * y) / sum(w) as m from w where w > 0 group by 1, 2), q as (select seq_id, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by 1), a as (select seq_id, avg(y) as mean from s group by 1) select seq_id, round(mean, 6) as mean, round(low, 6) as low, round(high, 6) as high from a join q using (seq_id)")
def bootstrap_ci(spark, sf):
    """Every weight of every draw under SQL: both sides take it from the same digest."""
    t = sequence(spark, sf, "values").withColumn("key", F.concat_ws(":", F.col("idx").cast("string")))
    return rounded(metrics.bootstrap_ci(t, "seq_id", "y", ["key"], 500, seed=7))


@query(f"with s as ({SEQ['ship']}), n as (select *, count(*) over (partition by seq_id) as n from s) select seq_id, idx from n where idx > floor(n * 0.4) and idx <= floor(n * 0.4) + floor(n * 0.15)")
def missing_block(spark, sf):
    return rounded(metrics.mask_block(sequence(spark, sf, "ship")).where("a = 0").select("seq_id", "idx"))


@query(f"with s as ({SEQ['ship']}), n as (select *, count(*) over (partition by seq_id) as n from s) select seq_id, idx from n where idx > round(n * 0.3) and idx <= round(n * 0.45)")
def holdout_window(spark, sf):
    return rounded(metrics.holdout(sequence(spark, sf, "ship"), 0.3, 0.45).where("held").select("seq_id", "idx"))


# ---- quadrature families ---------------------------------------------------------------------------------------------


def _fixed(s, **h):
    return s.select("seq_id").distinct().select("seq_id", *[F.lit(v).alias(k) for k, v in h.items()])


_X, _W = quadrature.legendre(16)
_NODES = "(values " + ", ".join(f"({g}, {a!r}::double, {b!r}::double)" for g, (a, b) in enumerate(zip(_X.tolist(), _W.tolist(), strict=True))) + ") t(g, x, wt)"
_HX, _HW = quadrature.hermite(20)
_HNODES = "(values " + ", ".join(f"({g}, {a!r}::double, {b!r}::double)" for g, (a, b) in enumerate(zip(_HX.tolist(), _HW.tolist(), strict=True))) + ") t(g, x, wt)"


def _node_sql(data: str, nodes: str, term: str, base: str, mean: str) -> str:
    return f"""with seq as (select * from ({SEQ[data]})), nodes as (select * from {nodes}),
    v as (select seq_id, idx, g, x, wt, sum({term}) over (partition by seq_id, g order by idx) as p from seq, nodes),
    pre as (select seq_id, idx as pos, g, x, wt, p from v union all select distinct seq_id, 0, g, x, wt, 0.0 from v),
    lw as (select a.seq_id, a.pos as i, b.pos as j, {base} + b.p - a.p as lw, {mean} as mean from (select *, x as xx from pre) a join pre b on a.seq_id = b.seq_id and a.g = b.g and a.pos < b.pos),
    m as (select *, max(lw) over (partition by seq_id, i, j) as top from lw)
    select seq_id, i, j, round(max(top) + ln(sum(exp(lw - top))), 4) as log_a0, round(sum(exp(lw - top) * mean) / sum(exp(lw - top)), 4) as a1 from m group by 1, 2, 3"""


@query(_node_sql("discount", _NODES, "lgamma(phi) - lgamma(phi * x) - lgamma(phi * (1 - x)) + (phi * x - 1) * ln(y) + (phi * (1 - x) - 1) * ln(1 - y)", "ln(b.wt) + 3 * ln(b.x) + 3 * ln(1 - b.x) - (2 * lgamma(4.0) - lgamma(8.0))", "b.x"))
def beta_obs_blocks(spark, sf):
    s = sequence(spark, sf, "discount")
    return rounded(quadrature.node_blocks(s, _fixed(s, alpha=4.0, beta=4.0), "beta_obs", 16), 4)


@query(_node_sql("discount", _NODES, "lgamma(phi) - lgamma(phi * x) - lgamma(phi * (1 - x)) + (phi * x - 1) * ln(y) + (phi * (1 - x) - 1) * ln(1 - y)", "ln(b.wt) + 3 * ln(b.x) + 3 * ln(1 - b.x) - (2 * lgamma(4.0) - lgamma(8.0))", "b.x"))
def beta_obs_kernel(spark, sf):
    """The same sums in the kernel that fits use: one level of nodes, nothing doubled."""
    s = sequence(spark, sf, "discount")
    return rounded(quadrature.integrated_blocks(s, _fixed(s, alpha=4.0, beta=4.0), "beta_obs", levels=(16,)).drop("error", "status", "nodes"), 4)


_TH = "(-0.5 + sqrt(2 * 0.8) * {0}x)"


@query(_node_sql("orders", _HNODES, f"y * {_TH.format('')} - n_trials * (greatest({_TH.format('')}, 0) + ln(1 + exp(-abs({_TH.format('')}))))", "ln(b.wt) - 0.5 * ln(pi())", f"1 / (1 + exp(-{_TH.format('b.')}))"))
def gh_blocks(spark, sf):
    s = sequence(spark, sf, "orders")
    return rounded(quadrature.node_blocks(s, _fixed(s, nu=-0.5, rho2=0.8), "logistic_normal", 20), 4)


@query(_node_sql("orders", _HNODES, f"y * {_TH.format('')} - n_trials * (greatest({_TH.format('')}, 0) + ln(1 + exp(-abs({_TH.format('')}))))", "ln(b.wt) - 0.5 * ln(pi())", f"1 / (1 + exp(-{_TH.format('b.')}))"))
def gh_kernel(spark, sf):
    """The same sums in the kernel that fits use."""
    s = sequence(spark, sf, "orders")
    h = _fixed(s, nu=-0.5, rho2=0.8)
    rows = s.join(h, "seq_id")

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("idx")
        ev, mean = quadrature.logistic(pdf, {"nu": float(pdf["nu"].iloc[0]), "rho2": float(pdf["rho2"].iloc[0])}, "gh", 20)
        i, j = np.triu_indices(len(pdf) + 1, 1)
        return pd.DataFrame({"seq_id": key[0], "i": i, "j": j, "log_a0": ev[i, j], "a1": mean[i, j]})

    return rounded(rows.groupBy("seq_id").applyInPandas(run, "seq_id string, i int, j int, log_a0 double, a1 double"), 4)


#: Evidence on a fine grid of the log odds by Simpson's rule, over the mode's surroundings where all of it lies.
_FINE = """, grid as (select seq_id, i, j, s, m, (s + 1) / (m + 2) as p from blk), ctr as (select *, ln(p / (1 - p)) as c, sqrt(1 / (m * p * (1 - p) + 1.25)) as v from grid),
pts as (select seq_id, i, j, v, k, case when k in (0, 240) then 1 when k % 2 = 1 then 4 else 2 end as wt, s, m, c + (k - 120) / 120.0 * 14 * v as t from ctr, range(0, 241) g(k)),
f as (select *, s * t - m * (greatest(t, 0) + ln(1 + exp(-abs(t)))) - pow(t + 0.5, 2) / 1.6 - 0.5 * ln(2 * pi() * 0.8) as f from pts), tp as (select *, max(f) over (partition by seq_id, i, j) as top from f)
select seq_id, i, j, 'ok' as status, round(max(top) + ln(sum(wt * exp(f - top)) * max(v) * 14 / 360), 4) as log_a0, round(sum(wt * exp(f - top) / (1 + exp(-t))) / sum(wt * exp(f - top)), 4) as a1 from tp group by 1, 2, 3"""


_COUNTS = f"""with recursive seq as ({SEQ['orders']}), pre as (select seq_id, idx as pos, sum(y) over w as s, sum(n_trials) over w as m from seq window w as (partition by seq_id order by idx) union all select distinct seq_id, 0, 0.0, 0.0 from seq),
blk as (select p.seq_id, p.pos as i, q.pos as j, q.s - p.s as s, q.m - p.m as m from pre p join pre q on p.seq_id = q.seq_id and p.pos < q.pos)"""
_SIG = "(1 / (1 + exp(-{0})))"
_MAC = "1 / (1 + exp(-({0}) / sqrt(1 + pi() * ({1}) / 8)))"
#: The posterior's mode by bisection; the values around it in closed form.
_LAPLACE = _COUNTS + f""", root as (select *, -60.0::double as lo, 60.0::double as hi, 0 as step from blk
  union all select seq_id, i, j, s, m, case when s - m * {_SIG.format('(lo + hi) / 2')} - ((lo + hi) / 2 + 0.5) / 0.8 > 0 then (lo + hi) / 2 else lo end, case when s - m * {_SIG.format('(lo + hi) / 2')} - ((lo + hi) / 2 + 0.5) / 0.8 > 0 then hi else (lo + hi) / 2 end, step + 1 from root where step < 60),
t as (select *, (lo + hi) / 2 as t from root where step = 60), h as (select *, m * {_SIG.format('t')} * (1 - {_SIG.format('t')}) + 1 / 0.8 as h from t)
select seq_id, i, j, round(s * t - m * (greatest(t, 0) + ln(1 + exp(-abs(t)))) - pow(t + 0.5, 2) / 1.6 - 0.5 * ln(2 * pi() * 0.8) + 0.5 * ln(2 * pi()) - 0.5 * ln(h), 6) as log_a0, round({_MAC.format('t', '1 / h')}, 6) as a1 from h"""
_LAM = "(case when xi < 1e-10 then 0.125 else (1 - exp(-xi)) / (1 + exp(-xi)) / (4 * xi) end)"
_JJ = _COUNTS + f""", it as (select *, 1.0::double as xi, 0 as step from blk union all select seq_id, i, j, s, m, sqrt(pow((s - m / 2 - 0.5 / 0.8) / (1 / 0.8 + 2 * m * {_LAM}), 2) + 1 / (1 / 0.8 + 2 * m * {_LAM})), step + 1 from it where step < 200),
v as (select *, 1 / (1 / 0.8 + 2 * m * {_LAM}) as v from it where step = 200), f as (select *, v * (s - m / 2 - 0.5 / 0.8) as mu from v)
select seq_id, i, j, round(0.5 * ln(v / 0.8) + 0.5 * (mu * mu / v - 0.25 / 0.8) + m * (-ln(1 + exp(-xi)) - xi / 2 + {_LAM} * xi * xi), 6) as log_a0, round({_MAC.format('mu', 'v')}, 6) as a1 from f"""


def _approx(name, sql=None):
    def run(spark, sf):
        s = sequence(spark, sf, "orders")
        return rounded(quadrature.approximate_blocks(s, _fixed(s, nu=-0.5, rho2=0.8), name))

    run.__name__ = f"{name}_blocks"
    return query(sql)(run)


laplace_blocks, jj_blocks, ep_blocks = _approx("laplace", _LAPLACE), _approx("jj", _JJ), _approx("ep")


@query(_COUNTS + _FINE)
def logistic_integrals(spark, sf):
    """Evidence by nodes around each block's mode, doubled until settled, with a status."""
    s = sequence(spark, sf, "orders")
    return rounded(quadrature.integrated_blocks(s, _fixed(s, nu=-0.5, rho2=0.8), "logistic_normal").drop("error", "nodes"), 4)


_EXACT, _NEAR = ((q.replace(", 4) as log_a0", ", 12) as log_a0").replace(", 6) as log_a0", ", 12) as log_a0")) for q in (_COUNTS + _FINE, _LAPLACE))


@query(
    f"with e as (select a.seq_id, abs(a.log_a0 - b.log_a0) as d from ({_EXACT}) a join ({_NEAR}) b using (seq_id, i, j)), m as (select seq_id, 0::bigint as mismatched, max(d) as max_error, median(d) as median_error, avg(d) as mean_error from e group by 1)"
    " select seq_id, mismatched, round(max_error, 5) as max_error, round(median_error, 5) as median_error, round(mean_error, 5) as mean_error, round(4 * max_error, 5) as eta, round(8 * max_error, 5) as log_odds, round(exp(-8 * max_error), 5) as ratio_low, round(exp(8 * max_error), 5) as ratio_high, round(least(1.0, exp(8 * max_error) - 1), 5) as tv from m"
)
def certify_laplace(spark, sf):
    """Error of the Laplace approximation against integrals that settled, and the bound that follows."""
    s = sequence(spark, sf, "orders")
    h = _fixed(s, nu=-0.5, rho2=0.8)
    e = diagnose.block_error(quadrature.integrated_blocks(s, h, "logistic_normal").where("status = 'ok'"), quadrature.approximate_blocks(s, h, "laplace"), 4)
    return rounded(e.join(diagnose.bounds(e, 4), "seq_id"), 5)


@query()
def laplace_report(spark, sf):
    """The fit on Laplace evidence against the fit on quadrature."""
    s = sequence(spark, sf, "orders")
    h = _fixed(s, nu=-0.5, rho2=0.8)
    exact, approx = (quadrature.approximate_blocks(s, h, m) for m in ("quadrature", "laplace"))
    return diagnose.non_conjugate(segment.fit_blocks(approx, 4), segment.fit_blocks(exact, 4), approx, exact, 4)


# ---- baselines -------------------------------------------------------------------------------------------------------

_L2 = f"""with s as ({SEQ['ship']}), p as (select seq_id, idx as pos, sum(y) over w as s, sum(y * y) over w as q from s window w as (partition by seq_id order by idx) union all select distinct seq_id, 0, 0.0, 0.0 from s),
c as (select a.seq_id, a.pos as i, b.pos as j, b.q - a.q - pow(b.s - a.s, 2) / (b.pos - a.pos) as c from p a join p b on a.seq_id = b.seq_id and b.pos - a.pos >= 2), n as (select seq_id, max(pos) as n from p group by 1)"""


@query(_L2 + " select x.seq_id, round(min(x.c + y.c + z.c) / 1000, 5) as cost from c x join c y on x.seq_id = y.seq_id and y.i = x.j join c z on z.seq_id = x.seq_id and z.i = y.j join n on n.seq_id = x.seq_id and z.j = n.n where x.i = 0 group by 1")
def optimal_partition_l2(spark, sf):
    return rounded(splits.optimal_partition(sequence(spark, sf, "ship"), 2).select("seq_id", (F.col("cost") / 1000).alias("cost")), 5)


#: Least penalised cost over all partitions, position after position; the list holds the best value of each prefix.
_PELT = f"""with recursive s as ({SEQ['ship']}), p as (select seq_id, idx as pos, sum(y) over w as s, sum(y * y) over w as q from s window w as (partition by seq_id order by idx) union all select distinct seq_id, 0, 0.0, 0.0 from s),
arr as (select seq_id, list(s order by pos) as s, list(q order by pos) as q, max(pos) as n from p group by 1),
dp as (select seq_id, 1::bigint as j, [-{{0}}, 'inf'::double] as best from arr union all
  select d.seq_id, d.j + 1, list_append(best, list_min(list_transform(range(0, d.j), lambda i: best[i + 1] + a.q[d.j + 2] - a.q[i + 1] - pow(a.s[d.j + 2] - a.s[i + 1], 2) / (d.j + 1 - i) + {{0}}))) from dp d join arr a using (seq_id) where d.j < a.n)
select dp.seq_id, round(best[n + 1] / 1000, 5) as objective from dp join arr using (seq_id) where j = n"""


@query(_PELT.format("2000.0"))
def pelt(spark, sf):
    d = baselines.detect(sequence(spark, sf, "ship"), "pelt", penalty=2000.0)
    return rounded(d.select("seq_id", ((F.col("cost") + 2000.0 * (F.size("boundaries") - 2)) / 1000).alias("objective")), 5)


@query(_L2 + """, g as (select w.seq_id, w.i, w.j, l.j as t, w.c - l.c - r.c as gain from c w join c l on l.seq_id = w.seq_id and l.i = w.i join c r on r.seq_id = w.seq_id and r.i = l.j and r.j = w.j),
one as (select g.seq_id, arg_max(t, gain) as t from g join n on n.seq_id = g.seq_id and g.i = 0 and g.j = n.n group by 1),
two as (select g.seq_id, arg_max(g.t, gain) as u from g join one using (seq_id) join n using (seq_id) where (g.i = 0 and g.j = one.t) or (g.i = one.t and g.j = n.n) group by 1)
select seq_id, least(t, u) as first, greatest(t, u) as second from one join two using (seq_id)""")
def binary_segmentation(spark, sf):
    d = splits.binary_segmentation(sequence(spark, sf, "ship"), changes=2)
    return rounded(d.select("seq_id", F.get("boundaries", F.lit(1)).alias("first"), F.get("boundaries", F.lit(2)).alias("second")))


@query()
def circular_segmentation(spark, sf):
    return baselines.detect(sequence(spark, sf, "ship"), "cbs")


@query()
def multiscale_segmentation(spark, sf):
    return baselines.detect(sequence(spark, sf, "ship"), "smuce")


@query()
def sampled_segmentation(spark, sf):
    return baselines.detect(sequence(spark, sf, "ship"), "mcmc", scale=2.0)


#: Ends of 60 wild windows per sequence from digests, the best split of each, then the best two of all candidates.
_WILD = """, e as (select seq_id, n, floor(('0x' || substr(h, 1, 8))::bigint / 4294967296.0 * (n + 1))::bigint as a, floor(('0x' || substr(h, 9, 8))::bigint / 4294967296.0 * (n + 1))::bigint as b from (select seq_id, n, md5(seq_id || ':' || k || ':3') as h from n, range(0, 60) t(k))),
w as (select distinct seq_id, least(a, b) as lo, greatest(a, b) as hi from e union select seq_id, 0, n from n),
sp as (select w.seq_id, w.lo, w.hi, l.j as t, c.c - l.c - r.c as gain from w join c on c.seq_id = w.seq_id and c.i = w.lo and c.j = w.hi join c l on l.seq_id = w.seq_id and l.i = w.lo join c r on r.seq_id = w.seq_id and r.i = l.j and r.j = w.hi),
cand as (select distinct seq_id, t from (select seq_id, lo, hi, arg_max(t, gain) as t from sp group by 1, 2, 3))
select n.seq_id, round(min(x.c + y.c + z.c) / 1000, 5) as cost, arg_min(u.t, x.c + y.c + z.c) as first, arg_min(v.t, x.c + y.c + z.c) as second from n join cand u on u.seq_id = n.seq_id join cand v on v.seq_id = n.seq_id and v.t >= u.t + 2
join c x on x.seq_id = n.seq_id and x.i = 0 and x.j = u.t join c y on y.seq_id = n.seq_id and y.i = u.t and y.j = v.t join c z on z.seq_id = n.seq_id and z.i = v.t and z.j = n.n group by 1"""


@query(_L2 + _WILD)
def wbs(spark, sf):
    d = splits.wild_binary_segmentation(sequence(spark, sf, "ship"), changes=2, windows=60, seed=3)
    return rounded(d.select("seq_id", (F.col("cost") / 1000).alias("cost"), F.get("boundaries", F.lit(1)).alias("first"), F.get("boundaries", F.lit(2)).alias("second")), 5)


_HELD = f"select * replace (case when idx > round(n * 0.3) and idx <= round(n * 0.45) then 0.0 else 1.0 end as a) from (select *, count(*) over (partition by seq_id) as n from ({SEQ['ship']}))"
_LD = "lgamma(y + alpha + s_s) - lgamma(alpha + s_s) - lgamma(y + 1) + (alpha + s_s) * ln((beta + s_e) / (beta + s_e + 1)) + y * ln(1 / (beta + s_e + 1))"


@query(
    sql_blocks(_HELD, "poisson", GIVEN["poisson"]) + ", " + sql_forward(4) + ", " + sql_posterior() + ", " + sql_best(4) + ", " + PATH
    + f""", seg as (select p.seq_id, p.i, p.j, true as fitted from path p union all select seq_id, 0, n, false from len),
    ld as (select seq.seq_id, fitted, avg({_LD}) as v from seg join dif using (seq_id, i, j) join seq on seq.seq_id = seg.seq_id and idx > i and idx <= j where a = 0 group by 1, 2)
    select x.seq_id, round(x.v, 6) as fitted, round(y.v, 6) as single, round(x.v - y.v, 6) as gain from ld x join ld y on x.seq_id = y.seq_id and x.fitted and not y.fitted"""
)
def null_comparison(spark, sf):
    s = sequence(spark, sf, "ship")
    return rounded(segment.null_comparison(s, "poisson", 4, 0.3, 0.45, given(s, "poisson")))


_RENEWAL = ", tilt as (select seq_id, i, j, s + 0.5 * ln(j - i) as s from blk), gee as (select seq_id, i, j, 0.5 * ln(j - i) as s from blk), " + sql_forward(4, "gee", "g", "gwd")


@query(
    _EV + _RENEWAL + ", " + sql_forward(4, "tilt") + ", " + sql_posterior("0.2 * pow(0.8, k - 1)", 4, "(select g.l from gwd g where g.seq_id = f.seq_id and g.k = f.k and g.j = f.j)") + ", " + sql_best(4, "tilt") + ", " + PATH
    + " select p.seq_id, p.q, p.i, p.j, round(a1, 6) as mean from path p join blk b using (seq_id, i, j)"
)
def renewal_fit(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(segment.renewal(s, "poisson", 4, 0.2, 0.5, given(s, "poisson")).segment)


@query(_EV + ", t as (select seq_id, n // 3 as t, n from len) select seq_id, round(0.5 * ln(t) + 0.5 * ln(n - t), 6) as log_prior from t")
def partition_prior(spark, sf):
    from ..operators import prior
    from ..sources import sequences as src

    s = sequence(spark, sf, "events")
    b = prior.with_prior(block_table(s, "poisson"), src.bounds(s), prior.Partition(cohesion="span", power=0.5))
    n = s.groupBy("seq_id").agg(F.max("idx").alias("n")).withColumn("t", F.floor(F.col("n") / 3).cast("int"))
    path = n.select("seq_id", F.lit(0).alias("i"), F.col("t").alias("j")).unionByName(n.select("seq_id", F.col("t").alias("i"), F.col("n").alias("j")))
    return rounded(prior.partition_log_prior(b, path))
