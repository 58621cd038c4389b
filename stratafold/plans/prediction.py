"""Queries over fitted segments: assignment, prediction, predictive densities, PIT, units, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import cols
from ..operators import pooled, predict, quadrature, segment
from ..sources import sequences as src
from .core import _K12, GIVEN, given, sequence
from .registry import EB, FAMILY, PATH, PHI, SEQ, load, query, rounded, sql_best, sql_blocks, sql_forward, sql_posterior

#: Fixed segmentation of every sequence into thirds, so that prediction is checked apart from fitting.
THIRDS = "cut as (select seq_id, max(idx) as n from seq group by 1), seg as (select seq_id, 1::bigint as q, 0::bigint as i, n // 3 as j from cut union all select seq_id, 2, n // 3, 2 * n // 3 from cut union all select seq_id, 3, 2 * n // 3, n from cut)"


def thirds(seq):
    n = seq.groupBy("seq_id").agg(F.max("idx").alias("n"))
    s = F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.col("n") * (q - 1) / 3).cast("int").alias("i"), F.floor(F.col("n") * q / 3).cast("int").alias("j")) for q in (1, 2, 3)])
    return n.select("seq_id", F.explode(s).alias("s")).select("seq_id", "s.*", F.lit(0.0).alias("mean"))


def queries_at(seq):
    """Query points between and beyond the training points, with the observation there as y."""
    return seq.select("seq_id", (F.col("x") + F.when(F.col("idx") % 2 == 0, 0.4).otherwise(-0.7)).alias("x"), "y", "w", "n_trials", "r", F.col("idx").alias("point"))


_Q = "qs as (select seq_id, idx as point, idx + case when idx % 2 = 0 then 0.4 else -0.7 end as x, y from seq)"


@query(f"with seq as ({SEQ['events']}), {_Q} select seq_id, point, round(x, 6) as x, greatest(1, cast(floor(x) as bigint)) as idx from qs")
def asof_assign(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(predict.locate(s, queries_at(s)).select("seq_id", "point", "x", "idx"))


@query(f"with seq as ({SEQ['events']}), {_Q}, {THIRDS} select qs.seq_id, point, q from qs join seg on seg.seq_id = qs.seq_id and greatest(1, floor(x)) > i and greatest(1, floor(x)) <= j")
def segment_index(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(predict.predict(s, thirds(s), queries_at(s)).select("seq_id", "point", "q"))


_STEP = "with seq as ({0}), {1}, {2}, m as (select seg.seq_id, q, i, j, avg(y) as mean from seg join seq on seq.seq_id = seg.seq_id and idx > i and idx <= j group by all)"


@query(_STEP.format(SEQ["events"], _Q, THIRDS) + " select qs.seq_id, point, round(mean, 6) as mean from qs join m on m.seq_id = qs.seq_id and greatest(1, floor(x)) > i and greatest(1, floor(x)) <= j")
def predict_step(spark, sf):
    s = sequence(spark, sf, "events")
    t = thirds(s).drop("mean")
    means = s.join(t, "seq_id").where("idx > i and idx <= j").groupBy("seq_id", "q", "i", "j").agg(F.avg("y").alias("mean"))
    return rounded(predict.predict(s, means, queries_at(s)).select("seq_id", "point", "mean"))


_DENS = {
    "gaussian": ("values", "-0.5 * ln(2 * pi() * v) - pow(y - mu, 2) / (2 * v)", "(rho2 * s_s + sigma2 * nu) / (rho2 * s_w + sigma2) as mu, sigma2 / greatest(w, 1e-12) + rho2 * sigma2 / (rho2 * s_w + sigma2) as v"),
    "poisson": ("events", "lgamma(y + r0) - lgamma(r0) - lgamma(y + 1) + r0 * ln(bb / (bb + 1)) + y * ln(1 / (bb + 1))", "alpha + s_s as r0, beta + s_e as bb"),
    "binomial": ("orders", "lgamma(n_trials + 1) - lgamma(y + 1) - lgamma(n_trials - y + 1) + (lgamma(a0 + y) + lgamma(b0 + n_trials - y) - lgamma(a0 + b0 + n_trials)) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0))", "alpha + s_s as a0, beta + s_m - s_s as b0"),
    "bernoulli": ("labels", "y * ln(a0 / (a0 + b0)) + (1 - y) * ln(1 - a0 / (a0 + b0))", "alpha + s_s as a0, beta + s_m - s_s as b0"),
    "beta": ("discount", "(a0 - 1) * ln(y) + (b0 - 1) * ln(1 - y) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0))", "alpha + s_s as a0, beta + s_m - s_s as b0"),
    "negbin": ("events", "lgamma(y + r) - lgamma(y + 1) - lgamma(r) + (lgamma(a0 + r) + lgamma(b0 + y) - lgamma(a0 + b0 + r + y)) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0))", "alpha + s_m as a0, beta + s_s as b0"),
}


def sql_scored(fam: str) -> str:
    data, dens, pars = _DENS[fam]
    sums = ", ".join(f"q2.p_{k} - q1.p_{k} as s_{k}" for k in FAMILY[fam][0])
    hyp = ", ".join(f"{v}::double as {k}" for k, v in GIVEN[fam].items())
    return (
        sql_blocks(SEQ[data], fam, GIVEN[fam])
        + f", {THIRDS}, par as (select seg.seq_id, q, i, j, {sums}, {hyp} from seg join pre q1 on q1.seq_id = seg.seq_id and q1.pos = i join pre q2 on q2.seq_id = seg.seq_id and q2.pos = j), pt as (select seq.*, par.* exclude (seq_id), {pars} from seq join par on par.seq_id = seq.seq_id and idx > i and idx <= j), scored as (select *, {dens} as ld from pt)"
    )


def scored(spark, sf, fam):
    s = sequence(spark, sf, _DENS[fam][0])
    q = s.select("seq_id", "x", "y", "w", "n_trials", "r", F.col("idx").alias("point"))
    return predict.score_points(s, fam, thirds(s), given(s, fam), q)


def _register():
    for fam in _DENS:

        def run(spark, sf, fam=fam):
            return rounded(scored(spark, sf, fam).select("seq_id", "point", F.col("log_density").alias("ld")))

        run.__name__ = f"predictive_{fam}"
        query(sql_scored(fam) + " select seq_id, idx as point, round(ld, 6) as ld from scored")(run)


_register()


@query(_K12 + f", {_Q} select qs.seq_id, point, round(exp(p1.log_post) * c1.c + exp(p2.log_post) * c2.c, 6) as mean from qs join c2 on c2.seq_id = qs.seq_id and c2.idx = greatest(1, floor(x)) join c1 on c1.seq_id = qs.seq_id join post p1 on p1.seq_id = qs.seq_id and p1.k = 1 join post p2 on p2.seq_id = qs.seq_id and p2.k = 2")
def predict_bayes(spark, sf):
    s = sequence(spark, sf, "events")
    fit = segment.segment(s, "poisson", 2, given(s, "poisson"))
    return rounded(predict.predict_bayes(s, fit.curve, queries_at(s)).select("seq_id", "point", "mean"))


@query(sql_scored("gaussian") + " select seq_id, idx as point, round(sum(ld) over (partition by seq_id order by idx), 6) as total, round(row_number() over (partition by seq_id order by idx) / count(*) over (partition by seq_id), 6) as share from scored")
def hll_trace(spark, sf):
    return rounded(predict.trace(scored(spark, sf, "gaussian")).select("seq_id", "point", "total", "share"))


@query(sql_scored("poisson") + " select seq_id, round(avg(ld), 6) as score from scored group by 1")
def model_score(spark, sf):
    return rounded(scored(spark, sf, "poisson").groupBy("seq_id").agg(F.avg("log_density").alias("score")))


@query(sql_scored("poisson") + ", u as (select seq_id, cast(floor((idx - 1) / 5) as bigint) as unit_id, sum(ld) as log_score from scored group by 1, 2) select *  replace (round(log_score, 6) as log_score) from u")
def unit_scores(spark, sf):
    t = scored(spark, sf, "poisson").withColumn("unit_id", F.floor((F.col("point") - 1) / 5))
    return rounded(predict.unit_scores(t).select("seq_id", "unit_id", "log_score"))


@query(sql_scored("poisson") + ", u as (select seq_id, cast(floor((idx - 1) / 5) as bigint) as unit_id, sum(ld) as log_score from scored group by 1, 2), e as (select *, exp(log_score - max(log_score) over (partition by unit_id)) as e from u) select seq_id, unit_id, round(e / sum(e) over (partition by unit_id), 6) as prob from e")
def unit_responsibility(spark, sf):
    t = scored(spark, sf, "poisson").withColumn("unit_id", F.floor((F.col("point") - 1) / 5))
    return rounded(predict.unit_responsibility(predict.unit_scores(t)).select("seq_id", "unit_id", "prob"))


#: Edges of the unit intervals, on the axis of the event sequences.
_EDGES = [0.5, 5.0, 12.0, 20.5, 26.0]


@query(f"with seq as ({SEQ['events']}), {_Q}, e as (select * from (values {', '.join(f'({k}::bigint, {a}::double, {b}::double)' for k, (a, b) in enumerate(zip(_EDGES[:-1], _EDGES[1:], strict=True)))}) t(unit_id, low, high)) select seq_id, point, unit_id, low, high from qs join e on x > low and x <= high")
def interval_units(spark, sf):
    s = sequence(spark, sf, "events")
    return rounded(predict.interval_units(queries_at(s), _EDGES).select("seq_id", "point", "unit_id", "low", "high"))


_UNITS = "iv as (select seq_id, unit_id::bigint as unit_id, unit_id * 2.5 - (ascii(seq_id) % 3) as low, unit_id * 2.5 - (ascii(seq_id) % 3) + pow(2, unit_id % 5) as high from (select distinct seq_id from seq), range(0, 12) t(unit_id))"


def _units(s):
    """Overlapping intervals that differ per sequence, lengths 1 to 16."""
    u, shift = F.col("unit_id"), F.ascii("seq_id") % 3
    iv = s.select("seq_id").distinct().withColumn("unit_id", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return iv.select("seq_id", "unit_id", (u * 2.5 - shift).alias("low"), (u * 2.5 - shift + F.pow(F.lit(2.0), u % 5)).alias("high"))


@query(sql_scored("poisson") + f", {_UNITS} select iv.seq_id, unit_id, low::double as low, high, count(s.idx) as n_points, round(coalesce(sum(ld), 0), 6) as log_score from iv left join scored s on s.seq_id = iv.seq_id and s.idx > low and s.idx <= high group by all")
def overlapping_units(spark, sf):
    """Log likelihood of units whose intervals overlap and differ per sequence; some hold no point."""
    from ..operators import units

    t = scored(spark, sf, "poisson").withColumn("x", F.col("point").cast("double"))
    return rounded(units.unit_log_likelihood(t, _units(sequence(spark, sf, "events"))))


@query(sql_scored("poisson") + ", g as (select seq_id, sum(ld) as s, case when seq_id < 'f' then 3.0 else 1.0 end as w from scored group by 1), p as (select *, s + ln(w) - max(s + ln(w)) over () as d from g) select seq_id, round(s, 6) as log_score, round(exp(d) / sum(exp(d)) over (), 6) as prob from p")
def group_prediction(spark, sf):
    """Each event type's model as a group; the fresh data are each group's own points."""
    t = scored(spark, sf, "poisson").withColumn("unit_id", F.col("point"))
    prior = t.select("seq_id").distinct().withColumn("weight", F.when(F.col("seq_id") < "f", 3.0).otherwise(1.0))
    return rounded(predict.predict_group(t, prior))


@query(sql_scored("gaussian") + " select seq_id, idx as point, round((y - mu) / sqrt(v), 6) as z from scored")
def pit_gauss_z(spark, sf):
    return rounded(predict.pit_gaussian(scored(spark, sf, "gaussian")).select("seq_id", "point", "z"))


@query(sql_scored("gaussian") + ", z as (select *, (y - mu) / sqrt(v) as z from scored) select seq_id, idx as point, round(" + PHI.format("z") + ", 6) as pit from z")
def pit_gauss(spark, sf):
    return rounded(predict.pit_gaussian(scored(spark, sf, "gaussian")).select("seq_id", "point", "pit"))


_PMF = "lgamma(k + r0) - lgamma(r0) - lgamma(k + 1) + r0 * ln(bb / (bb + 1)) + k * ln(1 / (bb + 1))"


@query(sql_scored("poisson") + f", g as (select seq_id, idx, y, unnest(range(0, cast(y as bigint) + 1)) as k, r0, bb from scored) select seq_id, idx as point, round(coalesce(sum(exp({_PMF})) filter (k < y), 0), 6) as pit_low, round(sum(exp({_PMF})), 6) as pit_high from g group by 1, 2")
def pit_discrete_bounds(spark, sf):
    return rounded(predict.pit_bounds(scored(spark, sf, "poisson"), "poisson").select("seq_id", "point", "pit_low", "pit_high"))


@query(sql_scored("beta") + ", g as (select *, list_sum(list_transform(range(1, 4001), lambda k: case when k = 4000 then 1 when k % 2 = 1 then 4 else 2 end * exp((a0 - 1) * ln(y * k / 4000.0) + (b0 - 1) * ln(1 - y * k / 4000.0) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0))))) as t from scored) select seq_id, idx as point, round(y / 12000.0 * t, 5) as pit from g")
def pit_beta(spark, sf):
    return rounded(predict.pit(scored(spark, sf, "beta"), "beta").select("seq_id", "point", "pit"), 5)


_MASS = {
    "binomial": "exp(lgamma(n_trials + 1) - lgamma(k + 1) - lgamma(n_trials - k + 1) + (lgamma(a0 + k) + lgamma(b0 + n_trials - k) - lgamma(a0 + b0 + n_trials)) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0)))",
    "negbin": "exp(lgamma(k + r) - lgamma(k + 1) - lgamma(r) + (lgamma(a0 + r) + lgamma(b0 + k) - lgamma(a0 + b0 + r + k)) - (lgamma(a0) + lgamma(b0) - lgamma(a0 + b0)))",
}


def _register_bounds():
    for fam, mass in _MASS.items():

        def run(spark, sf, fam=fam):
            return rounded(predict.pit_bounds(scored(spark, sf, fam), fam).select("seq_id", "point", "pit_low", "pit_high"))

        run.__name__ = f"pit_{fam}_bounds"
        query(sql_scored(fam) + f", g as (select *, unnest(range(0, cast(y as bigint) + 1)) as k from scored) select seq_id, idx as point, round(coalesce(sum({mass}) filter (k < y), 0), 6) as pit_low, round(sum({mass}), 6) as pit_high from g group by 1, 2")(run)


_register_bounds()
_N16 = "(values " + ", ".join(f"({g}, {a!r}::double, {b!r}::double)" for g, (a, b) in enumerate(zip(*(v.tolist() for v in quadrature.legendre(16)), strict=True))) + ") t(g, x, wt)"
_H20 = "(values " + ", ".join(f"({g}, {a!r}::double, {b!r}::double)" for g, (a, b) in enumerate(zip(*(v.tolist() for v in quadrature.hermite(20)), strict=True))) + ") t(g, x, wt)"
_BETA_LOG = "lgamma(phi) - lgamma(phi * x) - lgamma(phi * (1 - x)) + (phi * x - 1) * ln(y) + (phi * (1 - x) - 1) * ln(1 - y)"
_NODE = "with seq as ({0}), {1}, nodes as (select * from {2}), lw as (select s.seq_id, q, i, j, g, min({5}) as x, min({4}) + sum({3}) as lw from seq s join seg on seg.seq_id = s.seq_id and idx > i and idx <= j, nodes group by 1, 2, 3, 4, 5), nw as (select * replace (lw - m - ln(sum(exp(lw - m)) over (partition by seq_id, q)) as lw) from (select *, max(lw) over (partition by seq_id, q) as m from lw))"
_BN = _NODE.format(SEQ["discount"], THIRDS, _N16, _BETA_LOG, "ln(wt) + 3 * ln(x) + 3 * ln(1 - x) - (2 * lgamma(4.0) - lgamma(8.0))", "x")
_LT = "(-0.5 + sqrt(1.6) * x)"
_LN = _NODE.format(SEQ["orders"], THIRDS, _H20, f"y * {_LT} - n_trials * (greatest({_LT}, 0) + ln(1 + exp(-abs({_LT}))))", "ln(wt) - 0.5 * ln(pi())", f"1 / (1 + exp(-{_LT}))")


def _hyper(s, **h):
    return s.select("seq_id").distinct().select("seq_id", *[F.lit(v).alias(k) for k, v in h.items()])


@query(_BN + " select seq_id, q, g, round(exp(lw), 6) as weight from nw")
def node_weights(spark, sf):
    s = sequence(spark, sf, "discount")
    return rounded(predict.node_weights(s, "beta_obs", thirds(s), _hyper(s, alpha=4.0, beta=4.0), 16).select("seq_id", "q", "g", F.exp("lw").alias("weight")))


def _beta_scored(spark, sf):
    s = sequence(spark, sf, "discount")
    asked = s.select("seq_id", "x", "y", "phi", F.col("idx").alias("point"))
    return predict.score_nodes(s, "beta_obs", thirds(s), _hyper(s, alpha=4.0, beta=4.0), asked, 16)


@query(_BN + f", l as (select s.seq_id, s.idx, lw + {_BETA_LOG} as l from seq s join nw on nw.seq_id = s.seq_id and idx > i and idx <= j), t as (select *, max(l) over (partition by seq_id, idx) as m from l) select seq_id, idx as point, round(max(m) + ln(sum(exp(l - m))), 6) as ld from t group by 1, 2")
def predictive_beta_obs(spark, sf):
    return rounded(_beta_scored(spark, sf).select("seq_id", "point", F.col("log_density").alias("ld")))


@query(_BN + ", c as (select s.seq_id, s.idx, exp(lw) * 8 * y / 12000.0 * list_sum(list_transform(range(1, 4001), lambda k: case when k = 4000 then 1 when k % 2 = 1 then 4 else 2 end * pow(k / 4000.0, 7) * exp(lgamma(phi) - lgamma(phi * x) - lgamma(phi * (1 - x)) + (phi * x - 1) * ln(y * pow(k / 4000.0, 8)) + (phi * (1 - x) - 1) * ln(1 - y * pow(k / 4000.0, 8))))) as f from seq s join nw on nw.seq_id = s.seq_id and idx > i and idx <= j) select seq_id, idx as point, round(sum(f), 4) as pit from c group by 1, 2")
def pit_beta_obs(spark, sf):
    return rounded(_beta_scored(spark, sf).select("seq_id", "point", "pit"), 4)


@query(_LN + ", r as (select seq_id, q, i, j, sum(exp(lw) * x) as p from nw group by all) select s.seq_id, idx as point, round(y / n_trials * ln(p) + (1 - y / n_trials) * ln(1 - p), 6) as ld from seq s join r on r.seq_id = s.seq_id and idx > i and idx <= j")
def predictive_logit(spark, sf):
    """Bernoulli log density of the rate of each row."""
    s = sequence(spark, sf, "orders")
    asked = s.select("seq_id", "x", (F.col("y") / F.col("n_trials")).alias("y"), F.col("idx").alias("point"))
    return rounded(predict.score_nodes(s, "logistic_normal", thirds(s), _hyper(s, nu=-0.5, rho2=0.8), asked, 20).select("seq_id", "point", F.col("log_density").alias("ld")))


@query(sql_scored("gaussian") + ", z as (select *, " + PHI.format("((y - mu) / sqrt(v))") + " as pit from scored), r as (select *, row_number() over (partition by seq_id order by pit) as rn, count(*) over (partition by seq_id) as n from z) select seq_id, round(avg(ld), 6) as log_density, round(avg(case when pit between 0.025 and 0.975 then 1.0 else 0 end), 6) as coverage, round(max(greatest(rn / n - pit, pit - (rn - 1) / n)), 6) as ks from r group by 1")
def window_scores(spark, sf):
    from ..operators import metrics

    return rounded(metrics.window_scores(predict.pit_gaussian(scored(spark, sf, "gaussian"))))


@query(f"with seq as ({SEQ['events']}) select seq_id, min(idx)::double as low, max(idx)::double as high, 'nearest' as policy from seq group by 1")
def policy_record(spark, sf):
    return rounded(predict.policy_record(sequence(spark, sf, "events"), "nearest"))


@query(sql_scored("gaussian") + ", z as (select seq_id, (y - mu) / sqrt(v) as z from scored) select seq_id, round(avg(case when abs(z) <= 1.959963984540054 then 1.0 else 0 end), 6) as coverage from z group by 1")
def interval_coverage(spark, sf):
    t = predict.pit_gaussian(scored(spark, sf, "gaussian"))
    return rounded(t.groupBy("seq_id").agg(F.avg(F.when((F.col("pit") >= 0.025) & (F.col("pit") <= 0.975), 1.0).otherwise(0.0)).alias("coverage")))


# ---- shared boundaries -----------------------------------------------------------------------------------------------

_POOL = sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"]).replace("blk as (", "own as (") .replace(
    "len as (select seq_id, max(j) as n from blk group by 1)",
    "blk as (select 'all' as seq_id, i, j, sum(s) as s, avg(a1) as a1 from own group by i, j), len as (select seq_id, max(j) as n from blk group by 1)",
) + ", " + sql_forward(4)


def members(spark, sf):
    s = sequence(spark, sf, "events")
    return s.withColumn("member", F.col("seq_id")).withColumn("seq_id", F.lit("all"))


def member_hyper(s):
    return s.select(F.concat_ws("|", "seq_id", "member").alias("seq_id")).distinct().select("seq_id", *[F.lit(v).alias(k) for k, v in GIVEN["poisson"].items()])


@query(_POOL + " select seq_id, i, j, round(s, 6) as log_a0, round(a1, 6) as a1 from blk")
def pooled_blocks(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.pool(pooled.member_blocks(s, "poisson", "member", member_hyper(s))))


@query(_POOL + ", " + sql_posterior() + " select seq_id, k, round(log_py_k, 6) as log_py_k, round(exp(log_post), 6) as post from post")
def pooled_replicates(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.shared(s, "poisson", "member", 4, None, member_hyper(s))[0].posterior_k.select("seq_id", "k", "log_py_k", "post"))


_POOL_U = _POOL + ", " + sql_posterior(prior="1.0")


@query(_POOL_U + " select distinct seq_id, round(z, 6) as log_evidence from post")
def pooled_channels(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.shared(s, "poisson", "member", 4, "uniform", member_hyper(s))[0].summary.select("seq_id", "log_evidence"))


_SHARED = _POOL + ", " + sql_posterior() + ", " + sql_best(4) + ", " + PATH


@query(_SHARED + " select p.seq_id, o.seq_id as member, p.q, p.i, p.j, round(o.a1, 6) as mean from path p join own o on o.i = p.i and o.j = p.j")
def replicate_means(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.shared(s, "poisson", "member", 4, None, member_hyper(s))[1])


@query(_SHARED + f", {_Q.replace('from seq)', 'from seq where seq_id = (select min(seq_id) from seq))')} select 'all' as seq_id, o.seq_id as member, point, round(o.a1, 6) as mean from qs join path p on greatest(1, floor(x)) > p.i and greatest(1, floor(x)) <= p.j join own o on o.i = p.i and o.j = p.j")
def replicate_predictions(spark, sf):
    """Every member's step at query points between and beyond the shared axis."""
    s = members(spark, sf)
    means = pooled.shared(s, "poisson", "member", 4, None, member_hyper(s))[1]
    axis = s.select("seq_id", "idx", "x").distinct()
    asked = axis.select("seq_id", (F.col("x") + F.when(F.col("idx") % 2 == 0, 0.4).otherwise(-0.7)).alias("x"), F.col("idx").alias("point"))
    return rounded(pooled.predict_members(s, means, asked).select("seq_id", "member", "point", "mean"))


@query(_POOL + ", " + sql_posterior() + f" select distinct post.seq_id, round(z / (n * (select count(distinct seq_id) from own)), 6) as score from post join len using (seq_id)")
def replicate_score(spark, sf):
    s = members(spark, sf)
    size = s.select("member").distinct().count()  # the number of members, not their rows
    return rounded(pooled.score_shared(pooled.shared(s, "poisson", "member", 4, None, member_hyper(s))[0], size))


@query(_POOL_U + " select distinct post.seq_id, round(z / n, 6) as score from post join len using (seq_id)")
def channel_score(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.score_shared(pooled.shared(s, "poisson", "member", 4, "uniform", member_hyper(s))[0]))


@query(sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"]) + ", " + sql_forward(4) + ", " + sql_posterior() + ", z as (select distinct post.seq_id, z / n as v from post join len using (seq_id)) select 'all' as seq_id, round(avg(v), 6) as score from z")
def independent_score(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.score_independent(pooled.independent(s, "poisson", "member", 4, member_hyper(s))[0]))


@query(sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"]) + ", " + sql_forward(4) + ", " + sql_posterior() + ", z as (select distinct seq_id, z from post) select 'all' as seq_id, round(sum(z), 6) as log_evidence, count(*) as members from z")
def independent_channels(spark, sf):
    s = members(spark, sf)
    return rounded(pooled.independent(s, "poisson", "member", 4, member_hyper(s))[1])


@query("select l_returnflag as seq_id, round(sum(l_extendedprice), 2) as total, round(avg(l_extendedprice), 6) as mean, count(*) as n from lineitem group by 1")
def exact_totals(spark, sf):
    """Totals in which numbers up to 10^20 cancel: a plain sum of doubles would not keep a digit of the prices."""
    from ..functions.exact import exact_sum

    big = F.col("l_orderkey") * F.lit(1e12) + F.col("l_extendedprice")
    v = load(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", F.explode(F.array(big, -big, F.col("l_extendedprice"))).alias("v"))
    out = v.groupBy(F.col("l_returnflag").alias("seq_id")).agg(exact_sum("v").alias("total"), (F.count(F.lit(1)) / 3).cast("long").alias("n"))
    return out.select("seq_id", F.round("total", 2).alias("total"), F.round(F.col("total") / F.col("n"), 6).alias("mean"), "n")


@query(
    sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"]) + ", " + sql_forward(4) + ", " + sql_posterior()
    + """, z as (select distinct case when seq_id < 'f' then 'early' else 'late' end as label, post.seq_id, z, n from post join len using (seq_id))
    select label, seq_id, cast(grouping(label) * 2 + grouping(seq_id) as bigint) as level, round(sum(z), 6) as log_evidence, round(sum(z) / sum(n), 6) as per_row, count(*) as sequences from z group by rollup (label, seq_id)"""
)
def evidence_rollup(spark, sf):
    """Log evidence per sequence, per group of sequences and of all, in one pass."""
    s = sequence(spark, sf, "events")
    one = segment.segment(s, "poisson", 4, given(s, "poisson"), curves=False).summary
    one = one.withColumn("label", F.when(F.col("seq_id") < "f", "early").otherwise("late"))
    return rounded(pooled.evidence_levels(one, ["label", "seq_id"]))


_MONTHS = "select l, avg(l_quantity) as q, avg(l_extendedprice) / 1000 as p, avg(l_discount) * 100 as d from (select *, date_trunc('month', l_shipdate) as l from lineitem) group by 1"
_CHANNELS = f"select seq_id, idx, y, 1.0::double as w, 1.0::double as a from (select row_number() over (order by l) as idx, unnest(['0', '1', '2']) as seq_id, unnest([q, p, d])::double as y from ({_MONTHS}))"


@query(
    (sql_blocks(_CHANNELS, "gaussian", EB["gaussian"]).replace("blk as (", "own as (").replace(
        "len as (select seq_id, max(j) as n from blk group by 1)", "blk as (select 'all' as seq_id, i, j, sum(s) as s, avg(a1) as a1 from own group by i, j), len as (select seq_id, max(j) as n from blk group by 1)")
    + ", " + sql_forward(6) + ", " + sql_posterior("1.0", 6) + ", " + sql_best(6) + ", " + PATH)
    + " select p.seq_id, o.seq_id::bigint as member, p.q, p.i, p.j, round(o.a1, 6) as mean from path p join own o on o.i = p.i and o.j = p.j"
)
def quantity_channels(spark, sf):
    s = src.complete(src.quantity_channels(load(spark, sf, "lineitem")))
    return rounded(pooled.shared(s, "gaussian", "channel", 6)[1])


_EXEMPLAR = f"select label as seq_id, idx, sum(w * y) / sum(w) as y, sum(w) as w, 1.0::double as a from (select *, case when seq_id < 'f' then 'early' else 'late' end as label from ({SEQ['events']})) group by 1, 2"


@query(
    sql_blocks(_EXEMPLAR, "poisson", EB["poisson"]) + ", " + sql_forward(3) + ", " + sql_posterior(k_max=3) + ", " + sql_best(3) + ", " + PATH
    + f""", fresh as ({SEQ['events']}), size as (select case when seq_id < 'f' then 'early' else 'late' end as label, count(distinct seq_id) as weight from fresh group by 1),
    pt as (select f.seq_id as unit_id, p.seq_id as label, lgamma(y + alpha + s_s) - lgamma(alpha + s_s) - lgamma(y + 1) + (alpha + s_s) * ln((beta + s_e) / (beta + s_e + 1)) + y * ln(1 / (beta + s_e + 1)) as ld
      from path p join dif using (seq_id, i, j) join fresh f on f.idx > p.i and f.idx <= p.j),
    sc as (select unit_id, label, sum(ld) + ln(min(weight)) as v from pt join size using (label) group by 1, 2), top as (select *, max(v) over (partition by unit_id) as m from sc)
    select unit_id, label, round(v, 6) as log_score, round(exp(v - m) / sum(exp(v - m)) over (partition by unit_id), 6) as prob from top"""
)
def group_classifier(spark, sf):
    """Labels are two halves of the event types; the fresh sequences are the event types themselves."""
    s = sequence(spark, sf, "events").withColumn("label", F.when(F.col("seq_id") < "f", "early").otherwise("late"))
    return rounded(pooled.classify(s, s, "poisson", 3))


@query(f"with s as ({SEQ['events']}), l as (select *, case when seq_id < 'f' then 'early' else 'late' end as label from s) select label as seq_id, idx, round(sum(w * y) / sum(w), 6) as y, sum(w) as w from l group by 1, 2")
def group_exemplars(spark, sf):
    s = sequence(spark, sf, "events").withColumn("label", F.when(F.col("seq_id") < "f", "early").otherwise("late"))
    return rounded(pooled.exemplars(s).select("seq_id", "idx", "y", "w"))


@query("select x, round(lgamma(x), 6) as lgamma, round(lgamma(x) + lgamma(2.5) - lgamma(x + 2.5), 6) as lnbeta, round(1 / (1 + exp(-x)), 6) as sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) as softplus from (select distinct (l_quantity * l_quantity + l_linenumber) / 40.0::double as x from lineitem)")
def special_functions(spark, sf):
    x = load(spark, sf, "lineitem").select(((F.col("l_quantity") * F.col("l_quantity") + F.col("l_linenumber")) / F.lit(40.0)).alias("x")).distinct()
    c = F.col("x")
    return x.select("x", *[(F.round(e, 6) + 0.0).alias(n) for n, e in (("lgamma", cols.lgamma(c)), ("lnbeta", cols.lnbeta(c, F.lit(2.5))), ("sigmoid", cols.sigmoid(c)), ("softplus", cols.softplus(c)))])


_SHIP = sql_blocks(SEQ["ship"], "poisson", GIVEN["poisson"]) + ", " + sql_forward(4) + ", " + sql_posterior()


def _stitched(spark, sf, least):
    from ..operators import sliding

    s = sequence(spark, sf, "ship")
    return sliding.stitched(s, "poisson", 4, 40, 10, given(s, "poisson"), least=least)


@query(_SHIP + ", " + sql_best(4) + ", " + PATH + " select p.seq_id, p.q, p.i, p.j, round(a1, 6) as mean, kmap.k as k_map, round(post.z, 6) as log_evidence from path p join blk b using (seq_id, i, j) join kmap using (seq_id) join post on post.seq_id = p.seq_id and post.k = kmap.k")
def stitched_fit(spark, sf):
    """Windows whose candidates are all positions: the dense fit, by way of the lattice."""
    from ..operators import sliding

    f = _stitched(spark, sf, 0.0)
    return rounded(sliding.stitched_segment(f).join(f.select("seq_id", "k_map", "log_evidence"), "seq_id"))


@query(_SHIP + " select seq_id, k, round(log_post, 6) as log_post from post")
def stitched_posterior(spark, sf):
    f = _stitched(spark, sf, 0.0)
    return rounded(f.select("seq_id", F.posexplode("log_post").alias("k", "log_post")).select("seq_id", (F.col("k") + 1).alias("k"), "log_post"))


@query()
def sliding_window(spark, sf):
    from ..operators import sliding

    s = sequence(spark, sf, "ship")
    return sliding.fit(s, "poisson", 4, 40, 10, given(s, "poisson"))["curve"]


@query(f"with s as ({SEQ['ship']}), n as (select seq_id, max(idx) as n from s group by 1), st as (select distinct seq_id, least(g * 30, greatest(0, n - 40)) as start from n, range(0, 100) t(g) where g * 30 < n) select seq_id || '#' || start as seq_id, count(*) as n from st join s using (seq_id) where idx > start and idx <= start + 40 group by 1")
def sliding_window_rows(spark, sf):
    from ..operators import sliding

    return rounded(sliding.windows(sequence(spark, sf, "ship"), 40, 10).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")))


@query()
def sliding_predict(spark, sf):
    from ..operators import sliding

    s = sequence(spark, sf, "ship")
    return sliding.predict(s, sliding.fit(s, "poisson", 4, 40, 10, given(s, "poisson")), queries_at(s), "nearest").select("seq_id", "point", "x", "idx", "mean")
