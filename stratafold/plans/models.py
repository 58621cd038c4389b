"""Queries over latent groups and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixture
from ..streaming import resegment
from .core import GIVEN, given, sequence
from .registry import SEQ, query, rounded, sql_best, sql_blocks


def _vectors(spark, sf):
    s = sequence(spark, sf, "events")
    return mixture.vectors(s, "poisson", given(s, "poisson"))


_BLK = sql_blocks(SEQ["events"], "poisson", GIVEN["poisson"])
_RESP = "resp as (select seq_id, g::bigint as g, case when g = 0 then r else 1 - r end as r from (select distinct seq_id, (ascii(seq_id) % 7 + 1) / 9.0::double as r from seq), range(2) t(g))"


@query(
    _BLK + f""", {_RESP}, pool as (select g as seq_id, i, j, sum(r * s) as s from blk join resp using (seq_id) group by 1, 2, 3),
    size as (select g as seq_id, sum(r) as w, sum(sum(r)) over () as total, (select max(idx) from seq) as n from resp group by 1), {sql_best(3, "pool")},
    val as (select b.seq_id, k, v + w * (ln(pow(0.5, k - 1) / 1.75) - (lgamma(n) - lgamma(k) - lgamma(n - k + 1))) as val from best b join size using (seq_id) where j = n),
    top as (select seq_id, arg_max(k, val) as k, max(val) as objective from val group by 1),
    path as (select b.seq_id, b.k as q, b.j, b.i from top join size using (seq_id) join best b on b.seq_id = top.seq_id and b.k = top.k and b.j = n
      union all select p.seq_id, p.q - 1, p.i, b.i from path p join best b on b.seq_id = p.seq_id and b.k = p.q - 1 and b.j = p.i where p.q > 1)
    select p.seq_id as g, round(w / total, 6) as pi, k, round(objective, 6) as objective, q, i, j from path p join top using (seq_id) join size using (seq_id)"""
)
def mixture_m_step(spark, sf):
    """The templates of two groups under responsibilities that follow from the sequences' names."""
    vec = _vectors(spark, sf)
    r = (F.ascii("seq_id") % 7 + 1) / F.lit(9.0)
    resp = vec.select("seq_id", F.posexplode(F.array(r, 1 - r)).alias("g", "r"))
    t = mixture.templates(vec, resp, 3)
    cut = F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda q: F.struct(q.alias("q"), F.get("cuts", q - 1).alias("i"), F.get("cuts", q).alias("j")))
    return rounded(t.withColumn("b", F.explode(cut)).select("g", "pi", "k", "objective", "b.q", "b.i", "b.j"))


@query(
    _BLK + """, tmpl as (select g, unnest(pi) as pi, unnest(o) as o, unnest(i) as i, unnest(j) as j from (
      select 0 as g, [0.25, 0.25] as pi, [-4.0, -4.0] as o, [0, n // 3] as i, [n // 3, n] as j from (select max(idx) as n from seq)
      union all select 1, [0.75, 0.75, 0.75], [-6.0, -6.0, -6.0], [0, n // 2, n - 2], [n // 2, n - 2, n] from (select max(idx) as n from seq))),
    sc as (select seq_id, g, sum(s) + min(o) + ln(min(pi)) as v from blk join tmpl using (i, j) group by 1, 2),
    z as (select *, max(v) over (partition by seq_id) as m from sc)
    select seq_id, g::bigint as g, round(exp(v - m - ln(sum(exp(v - m)) over (partition by seq_id))), 6) as r, round(m + ln(sum(exp(v - m)) over (partition by seq_id)), 6) as z from z"""
)
def mixture_e_step(spark, sf):
    """Responsibilities and log likelihoods of all sequences under two given templates."""
    vec = _vectors(spark, sf)
    n = mixture.rows_of(vec)
    t = spark.createDataFrame([(0, 0.25, [0, n // 3, n], -4.0), (1, 0.75, [0, n // 2, n - 2, n], -6.0)], "g int, pi double, cuts array<int>, offset double")
    return rounded(mixture.responsibilities(vec, t))


@query()
def mixture_em(spark, sf):
    return mixture.fit(_vectors(spark, sf), 2, 3, 2, rounds=6)["members"]


@query()
def mixture_select_g(spark, sf):
    return mixture.choose_groups(_vectors(spark, sf), [1, 2], 3, folds=2, restarts=1)


@query()
def stream_resegment(spark, sf):
    return resegment.stream_events(spark, sf)
