r"""Chat formatting with budgeted windows (DataFrame functions only).

Template. A turn is `### <role>: <text></turn>` and a newline. Inside roles and texts `\`, `<` and `#` (in roles also `:`)
are written `\b`, `\l`, `\h`, `\c`, so no text can hold a control string and the form is reversible.

Windows. A turn costs its words plus `overhead` tokens. Prefix sums of these costs place each turn on a line that is cut
into cells of `budget - history - system` tokens: turns inside a cell form one window, a turn that crosses a cell's end
is a window of its own. So windows are turn-aligned and within the budget, unless one turn alone exceeds it (never cut)
or the system turn alone exceeds `budget - history`: then every turn is a window of its own behind the system turn.
Each window repeats the conversation's system turn and the last turns before it, up to `history` tokens. The loss mask
covers assistant texts that are not repeats, so each is learnt exactly once.

Scale. One shuffle by conversation for the prefix sums; a window's rows meet by (conversation, window), never a whole
conversation. History is an equi-join on (conversation, bucket of `history` tokens), at most two rows per turn.

Defined cases. Null text is empty; null role is an empty role; null conv_id rows form one conversation; equal turns are
ordered by role, then text; repeated rows are turns of their own. Other columns are ignored. No rows give no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUDGET, HISTORY, OVERHEAD = 512, 128, 4
END = "</turn>\n"


def escape(col, role: bool = False):
    for a, b in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")) + (((":", "\\c"),) if role else ()):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def unescape(col):
    for a, b in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def turns(conversations: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """Turns in order with their costs: conv_id, rn (from 1), role, text, tok, sys_role, sys_text, sys_tok, s, e, where
    s and e are the prefix sums before and after the turn; a leading system turn costs nothing there."""
    t = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumn("rn", F.row_number().over(by)).withColumn(
        "tok", (F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + overhead).cast("long")
    )
    lead = (F.col("rn") == 1) & (F.col("role") == "system")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("sys", F.first(F.when(lead, F.struct("role", "text", "tok"))).over(run))
    t = t.withColumn("e", F.sum(F.when(lead, F.lit(0)).otherwise(F.col("tok"))).over(run))
    return t.withColumn("s", F.col("e") - F.when(lead, F.lit(0)).otherwise(F.col("tok")))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, overhead: int = OVERHEAD) -> DataFrame:
    """One row per window: conv_id, window (order within the conversation), n_context (repeated turns at its front),
    n_tokens, formatted, loss ARRAY<STRUCT<start, length>> in code points of `formatted`."""
    t = turns(conversations, overhead)
    w = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("sys.tok", F.lit(0)))
    t = t.withColumn("cell", F.floor(F.col("s") / w)).withColumn("cross", (F.col("e") > (F.col("cell") + 1) * w).cast("int"))
    new = t.select("conv_id", "cell", "cross", "rn", "role", "text", "tok", F.lit(1).alias("fresh"))
    spans = t.groupBy("conv_id", "cell", "cross").agg(F.min("s").alias("s0"), F.min("rn").alias("rn0"), F.first("sys").alias("sys"))
    kept = spans.where("sys is not null and rn0 > 1").select(
        "conv_id", "cell", "cross", F.lit(1).alias("rn"), "sys.role", "sys.text", "sys.tok", F.lit(0).alias("fresh")
    )
    left = spans.select(
        F.col("conv_id").alias("c"), "cell", "cross", "s0", "rn0", F.floor(F.col("s0") / history).alias("bucket")
    )
    past = t.where(f"tok <= {history} and not (rn = 1 and role = 'system')").select(
        "conv_id", "rn", "role", "text", "tok", "s", "e",
        F.explode(F.expr(f"sequence(floor(e / {history}), floor((s + {history}) / {history}))")).alias("bucket"),
    )
    again = (
        left.join(past, left.c.eqNullSafe(past.conv_id) & (left.bucket == past.bucket) & (past.rn < left.rn0)
                  & (past.e <= left.s0) & (left.s0 - past.s <= history))
        .select("conv_id", "cell", "cross", "rn", "role", "text", "tok", F.lit(0).alias("fresh"))
    )
    rows = new.unionByName(kept).unionByName(again)
    head = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": "))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "cell", "cross", F.struct("rn", "fresh", "role", "tok", head.alias("head"), body.alias("body")).alias("t"))
    one = rows.groupBy("conv_id", "cell", "cross").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # code point offsets of the texts under the mask, by a running length
    mask = f"""aggregate(ts, struct(cast(0 as bigint) as at, cast(array() as array<struct<start:bigint,length:bigint>>) as spans),
        (a, x) -> struct(a.at + char_length(x.head) + char_length(x.body) + {len(END)} as at,
            if(x.fresh = 1 and x.role = 'assistant', array_append(a.spans,
                struct(a.at + char_length(x.head) as start, cast(char_length(x.body) as bigint) as length)), a.spans) as spans), a -> a.spans)"""
    return one.select(
        "conv_id", (F.col("cell") * 2 + F.col("cross")).alias("window"),
        F.expr("size(filter(ts, x -> x.fresh = 0))").alias("n_context"),
        F.expr("aggregate(ts, cast(0 as bigint), (a, x) -> a + x.tok)").alias("n_tokens"),
        F.array_join(F.transform("ts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.expr(mask).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows back to what they hold, from `formatted`, `n_context` and `loss` alone: conv_id, window,
    turns ARRAY<STRUCT<role, text>> without repeats, learnt ARRAY<STRING>, formatted_chars."""
    parts = F.slice(F.split("formatted", END), F.col("n_context") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", END)) - 1 - F.col("n_context")))
    return formatted.select(
        "conv_id", "window",
        F.transform(parts, lambda p: F.struct(
            unescape(F.substr(F.substring_index(p, ": ", 1), F.lit(5))).alias("role"),
            unescape(F.substr(p, F.instr(p, ": ") + 2)).alias("text"))).alias("turns"),
        F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))).alias("learnt"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered query: all conversations and conversation -7, formatted, read back and digested."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    bad = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", bad), (-7, 1, "assistant", bad)], "conv_id long, turn long, role string, text string")
    back = read_back(windows(conv.unionByName(extra)))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    one = back.groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("window", line.alias("line"), F.array_join("learnt", "").alias("learnt")))).alias("w"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    learnt = F.array_join(F.transform("w", lambda x: x["learnt"]), "")
    return one.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["line"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP5_SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t0 as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as rn,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {OVERHEAD} as tok,
    4 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + {len(END)} as chars
  from c),
t1 as (
  select *, rn = 1 and role = 'system' as lead_sys from t0),
t2 as (
  select *, sum(case when lead_sys then 0 else tok end) over (partition by conv_id order by rn rows unbounded preceding) as e,
    max(case when lead_sys then tok end) over (partition by conv_id) as sys_tok,
    max(case when lead_sys then chars end) over (partition by conv_id) as sys_chars from t1),
t3 as (
  select *, e - case when lead_sys then 0 else tok end as s, greatest(1, {BUDGET - HISTORY} - coalesce(sys_tok, 0)) as w from t2),
t4 as (select *, cast(floor(s / w) as bigint) as cell, e > (cast(floor(s / w) as bigint) + 1) * w as crosses from t3),
spans as (select conv_id, cell, crosses, min(s) as s0, min(rn) as rn0, sum(chars) as chars, max(sys_chars) as sys_chars from t4 group by all),
again as (
  select p.conv_id, p.cell, p.crosses, sum(t.chars) as chars from spans p join t4 t on p.conv_id is not distinct from t.conv_id
    and t.rn < p.rn0 and t.e <= p.s0 and p.s0 - t.s <= {HISTORY} and t.tok <= {HISTORY} and not t.lead_sys group by all),
size as (
  select p.conv_id, cast(sum(p.chars + coalesce(a.chars, 0) + case when rn0 > 1 then coalesce(sys_chars, 0) else 0 end) as bigint) as formatted_chars
  from spans p left join again a on p.conv_id is not distinct from a.conv_id and p.cell = a.cell and p.crosses = a.crosses group by 1),
d as (
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by rn)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by rn) filter (role = 'assistant'), '')) as loss_sha256 from t4 group by conv_id)
select d.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from d join size on d.conv_id is not distinct from size.conv_id
"""
