"""The registry and the SQL pieces that oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison (+ 0.0 turns -0.0 into 0.0); whole numbers as they are."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else (F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c)) for c, t in df.dtypes])


def finite_rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """`rounded` for many rows whose doubles are finite: half away from zero as in the SQL, without decimals (round of a
    double goes through one, which takes longer than the rest of a block)."""
    unit = 10.0**digits
    half_up = lambda c: F.signum(c) * F.floor(F.abs(F.col(c)) * unit + 0.5) / unit + 0.0
    return df.select(*[half_up(c).alias(c) if t == "double" else (F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c)) for c, t in df.dtypes])


def _seq(key: str, bucket: str, y: str, source: str, more: str = "") -> str:
    return f"select *, cast(row_number() over (partition by seq_id order by b) as bigint) as idx from (select {key} as seq_id, {bucket} as b, {y} as y{more} from {source} group by 1, 2)"


ONES = "1.0::double as w, 1.0::double as a, 1.0::double as n_trials, 1.0::double as r, 1.0::double as phi"
SEQ = {
    "events": _seq("event_type", "date_trunc('day', ts)", "count(*)::double", "events", f", {ONES}"),
    "values": _seq("event_type", "date_trunc('day', ts)", "avg(value)", "events", ", count(*)::double as w, 1.0::double as a"),
    "errors": _seq("'all'", "date_trunc('day', ts)", "count(*) filter (event_type = 'error')::double", "events", ", count(*)::double as n_trials, 1.0::double as w, 1.0::double as a"),
    "ship": _seq("l_returnflag", "date_trunc('month', l_shipdate)", "count(*)::double", "lineitem", f", {ONES}"),
    "discount": _seq("l_returnflag", "date_trunc('month', l_shipdate)", "avg(l_discount) * 10", "lineitem", ", count(*)::double as phi, 1.0::double as w, 1.0::double as a"),
    "orders": _seq("o_orderpriority", "date_trunc('month', o_orderdate)", "count(*) filter (o_orderstatus = 'F')::double", "orders", ", count(*)::double as n_trials, 1.0::double as w, 1.0::double as a"),
    "labels": "select * from (select *, cast(row_number() over (partition by seq_id order by doc_id) as bigint) as idx, 1.0::double as w, 1.0::double as a from (select 'quality' as seq_id, doc_id, quality::double as y from labels union all select 'toxic', doc_id, toxic::double from labels))",
}

LNB = "(lgamma({0}) + lgamma({1}) - lgamma(({0}) + ({1})))"


def lnb(a: str, b: str) -> str:
    return LNB.format(a, b)


#: Terms per row and (evidence, mean) per block, as SQL over columns y, w, a, ... and block sums s_<term>.
FAMILY = {
    "gaussian": (
        {"n": "a", "w": "a * w", "s": "a * w * y", "q": "a * w * y * y", "l": "case when w > 0 then a * ln(w) else 0 end"},
        "-0.5 * s_n * ln(2 * pi() * sigma2) + 0.5 * s_l - 0.5 * ln(1 + s_w * rho2 / sigma2) + ((s_s - nu * s_w) * (s_s - nu * s_w) / (s_w + sigma2 / rho2) - (s_q - 2 * nu * s_s + nu * nu * s_w)) / (2 * sigma2)",
        "(rho2 * s_s + sigma2 * nu) / (rho2 * s_w + sigma2)",
    ),
    "poisson": (
        {"s": "a * y", "e": "a * w", "k": "a * (y * case when w > 0 then ln(w) else 0 end - lgamma(y + 1))"},
        "s_k + alpha * ln(beta) - lgamma(alpha) + lgamma(alpha + s_s) - (alpha + s_s) * ln(beta + s_e)",
        "(alpha + s_s) / (beta + s_e)",
    ),
    "binomial": (
        {"s": "a * w * y", "m": "a * w * n_trials", "k": "a * w * (lgamma(n_trials + 1) - lgamma(y + 1) - lgamma(n_trials - y + 1))"},
        f"s_k + {lnb('alpha + s_s', 'beta + s_m - s_s')} - {lnb('alpha', 'beta')}",
        "(alpha + s_s) / (alpha + beta + s_m)",
    ),
    "bernoulli": ({"s": "a * w * y", "m": "a * w"}, f"{lnb('alpha + s_s', 'beta + s_m - s_s')} - {lnb('alpha', 'beta')}", "(alpha + s_s) / (alpha + beta + s_m)"),
    "beta": (
        {"s": "a * w * 20 * y", "m": "a * w * 20", "k": "a * w * (lgamma(21.0) - lgamma(20 * y + 1) - lgamma(20 * (1 - y) + 1))"},
        f"s_k + {lnb('alpha + s_s', 'beta + s_m - s_s')} - {lnb('alpha', 'beta')}",
        "(alpha + s_s) / (alpha + beta + s_m)",
    ),
    "negbin": (
        {"m": "a * w * r", "s": "a * w * y", "k": "a * w * (lgamma(y + r) - lgamma(y + 1) - lgamma(r))", "rs": "r", "c": "1.0"},
        f"s_k + {lnb('alpha + s_m', 'beta + s_s')} - {lnb('alpha', 'beta')}",
        "case when alpha + s_m > 1 then s_rs / s_c * (beta + s_s) / (alpha + s_m - 1) else 'nan'::double end",
    ),
}


#: Empirical-Bayes hyperparameters as SQL over the CTE seq.
EB = {
    "poisson": "select seq_id, alpha, greatest(1e-8, alpha / greatest(m, 1e-12)) as beta from (select *, case when v > m + 1e-12 then greatest(1e-8, m * m / (v - m)) else 1e6 end as alpha from (select seq_id, min(m) as m, sum(w * pow(y / w - m, 2)) / sum(w) as v from (select *, sum(y) over (partition by seq_id) / sum(w) over (partition by seq_id) as m from seq) group by 1))",
    "gaussian": "select seq_id, min(nu) as nu, greatest(abs(sum(d * (y - nu) * (y2 - nu)) / greatest(sum(d), 1)), 1e-12) as rho2, greatest(sum(d * pow(y2 - y, 2)) / (2 * greatest(sum(d), 1)), 1e-12) as sigma2 from (select *, lead(y) over (partition by seq_id order by idx) as y2, (w + lead(w) over (partition by seq_id order by idx)) / 2 as d, sum(w * y) over (partition by seq_id) / sum(w) over (partition by seq_id) as nu from seq) group by 1",
}


def sql_blocks(seq: str, fam: str, given: dict[str, float] | str, more: str = "") -> str:
    """CTEs seq, pre, blk(seq_id, i, j, s, a1) with fixed hyperparameters, or those of a query."""
    terms, ev, mean = FAMILY[fam]
    sums = ", ".join(f"sum({e}) over (partition by seq_id order by idx) as p_{k}" for k, e in terms.items())
    zeros = ", ".join("0.0" for _ in terms)
    diff = ", ".join(f"q.p_{k} - p.p_{k} as s_{k}" for k in terms)
    hyp, cte, join = ("hyp.* exclude (seq_id)", f"hyp as ({given}),", "join hyp on hyp.seq_id = p.seq_id") if isinstance(given, str) else (", ".join(f"{v}::double as {k}" for k, v in given.items()), "", "")
    return f"""with recursive seq as (select *{more} from ({seq})), {cte}
    pre as (select seq_id, idx as pos, {sums} from seq union all select distinct seq_id, 0, {zeros} from seq),
    dif as (select p.seq_id, p.pos as i, q.pos as j, {diff}, {hyp} from pre p join pre q on p.seq_id = q.seq_id and p.pos < q.pos {join}),
    blk as (select seq_id, i, j, {ev} as s, {mean} as a1 from dif),
    len as (select seq_id, max(j) as n from blk group by 1)"""


def _lse(value: str, keys: str, source: str) -> str:
    return f"select {keys}, m + ln(sum(exp(v - m))) as l from (select {keys}, v, max(v) over (partition by {keys}) as m from (select {value} as v, {source})) group by {keys}, m"


def sql_forward(k_max: int, blk: str = "blk", one: str = "f", all_: str = "fwd") -> str:
    """CTEs f1..fK and fwd(seq_id, k, j, l); `one` and `all_` name them otherwise."""
    out = [f"{one}1 as (select seq_id, j, s as l from {blk} where i = 0)"]
    for k in range(2, k_max + 1):
        out.append(f"{one}{k} as ({_lse('f.l + b.s', 'seq_id, j', f'b.seq_id, b.j from {one}{k - 1} f join {blk} b on b.seq_id = f.seq_id and b.i = f.j')})")
    return ", ".join(out) + f", {all_} as (" + " union all ".join(f"select seq_id, {k}::bigint as k, j, l from {one}{k}" for k in range(1, k_max + 1)) + ")"


def sql_backward(k_max: int, blk: str = "blk") -> str:
    """CTEs r1..rK and bwd(seq_id, k, i, l)."""
    out = [f"r1 as (select b.seq_id, i, s as l from {blk} b join len on len.seq_id = b.seq_id and b.j = len.n)"]
    for k in range(2, k_max + 1):
        out.append(f"r{k} as ({_lse('f.l + b.s', 'seq_id, i', f'b.seq_id, b.i from r{k - 1} f join {blk} b on b.seq_id = f.seq_id and b.j = f.i')})")
    return ", ".join(out) + ", bwd as (" + " union all ".join(f"select seq_id, {k}::bigint as k, i, l from r{k}" for k in range(1, k_max + 1)) + ")"


def sql_posterior(prior: str = "pow(0.5, k - 1)", k_max: int = 4, log_c: str = "(lgamma(n) - lgamma(k) - lgamma(n - k + 1))") -> str:
    """CTE post(seq_id, k, log_c, log_py_k, log_post)."""
    norm = f"(select sum(pow(p, 1)) from (select {prior} as p from range(1, {k_max + 1}) t(k)))"
    return f"""raw as (select f.seq_id, f.k, {log_c} as log_c, f.l - {log_c} as log_py_k, f.l - {log_c} + ln({prior} / {norm}) as v from fwd f join len on len.seq_id = f.seq_id and f.j = len.n),
    post as (select seq_id, k, log_c, log_py_k, v - (m + ln(sum(exp(v - m)) over (partition by seq_id))) as log_post, m + ln(sum(exp(v - m)) over (partition by seq_id)) as z from (select *, max(v) over (partition by seq_id) as m from raw))"""


def sql_best(k_max: int, blk: str = "blk") -> str:
    """CTEs m1..mK and best(seq_id, k, j, v, i): score of the best partition of the first j rows and where its last block begins."""
    out = [f"m1 as (select seq_id, j, s as v, 0::bigint as i from {blk} where i = 0)"]
    for k in range(2, k_max + 1):
        out.append(f"m{k} as (select b.seq_id, b.j, max(m.v + b.s) as v, arg_max(b.i, m.v + b.s) as i from m{k - 1} m join {blk} b on b.seq_id = m.seq_id and b.i = m.j group by 1, 2)")
    return ", ".join(out) + ", best as (" + " union all ".join(f"select seq_id, {k}::bigint as k, j, v, i from m{k}" for k in range(1, k_max + 1)) + ")"


#: CTEs kmap and path(seq_id, q, i, j): the most probable number of segments and the best partition into as many.
PATH = """kmap as (select seq_id, arg_max(k, log_post) as k from post group by 1),
path as (select b.seq_id, b.k as q, b.j, b.i from kmap join len using (seq_id) join best b on b.seq_id = kmap.seq_id and b.k = kmap.k and b.j = n
  union all select p.seq_id, p.q - 1, p.i, b.i from path p join best b on b.seq_id = p.seq_id and b.k = p.q - 1 and b.j = p.i where p.q > 1)"""
#: The normal distribution function of z by Simpson's rule.
PHI = "(0.5 + {0} / 1200.0 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda k: case when k = 0 or k = 400 then 1 when k % 2 = 1 then 4 else 2 end * exp(-pow({0} * k / 400.0, 2) / 2))))"
