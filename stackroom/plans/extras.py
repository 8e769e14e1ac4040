"""Sources, provider functions and extras beyond the inventory: event-time windows, sketches (groups A, I, J, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import providers as P
from ..sources import records as R
from .base import inline, query, table

@query("a14_markdown_notes", "select conv_id doc, '# Notes' || chr(10) || chr(10) || string_agg('## p. ' || turn || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> '), chr(10) || chr(10) order by turn) || chr(10) as value from conversations group by 1")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit(0.0).alias("top"), F.col("turn").alias("id"), F.col("text").alias("quote"), F.lit("").alias("comment"))
    return R.markdown_notes(c, "Notes")


@query("a15_json_notes", "select conv_id doc, count(*)::bigint n from conversations group by 1")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.lit(0.0).alias("top"), F.col("turn").alias("id"), F.col("text").alias("quote"), F.lit("").alias("comment"))
    return R.json_notes(c).select("doc", F.size(F.from_json("value", "notes array<struct<id:bigint>>")["notes"]).cast("long").alias("n"))


@query("a25_work_record", "select 'W' || p_partkey as \"key\", p_name title, 2000 + p_size as \"year\", '10.1/abc' || p_partkey doi, p_size cited_by, ['W' || (p_partkey + 1)] reference_keys, 'a b c' || p_size || ' b' abstract from part")
def _(spark, d):
    k, z = F.col("p_partkey").cast("string"), F.col("p_size")
    index = F.map_from_arrays(F.array(F.lit("b"), F.lit("a"), F.concat(F.lit("c"), z.cast("string"))), F.array(F.array(F.lit(1), F.lit(3)), F.array(F.lit(0)), F.array(F.lit(2))))
    raw = F.struct(F.concat(F.lit("https://x.org/W"), k).alias("id"), F.col("p_name").alias("display_name"), (2000 + z).alias("publication_year"), F.concat(F.lit("https://doi.org/10.1/ABC"), k).alias("doi"), z.alias("cited_by_count"), F.array(F.concat(F.lit("W"), (F.col("p_partkey") + 1).cast("string"))).alias("referenced_works"), index.alias("abstract_inverted_index"))
    return R.work_of(table(spark, d, "part").select(F.to_json(raw).alias("value")))


@query("j01_provider_call", "select conv_id, turn, length(text)::int n from conversations")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return P.call(c, P.echo).select("conv_id", "turn", F.length("reply").alias("n"))


@query("j12_memoised_calls", "select conv_id, turn, length(text)::int n from conversations")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    out, _ = P.memoised(c, inline(spark, "key string, reply string", []), P.echo)
    return out.select("conv_id", "turn", F.length("reply").alias("n"))


@query("j09_hashed_embedding", "with w as (select item_id, ('0x' || substr(md5(w), 1, 16))::ubigint h from (select item_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) w from benchmark)), b as (select item_id, (h % 64)::int i, sum(case when h >= 9223372036854775808 then 1.0 else -1.0 end) v from w group by all), n as (select item_id, sqrt(sum(v * v)) n from b group by 1) select item_id, list(round(coalesce(v / n, 0), 5) order by i) embedding from (select item_id, i from (select distinct item_id from w), range(0, 64) r(i)) left join b using (item_id, i) join n using (item_id) group by 1")
def _(spark, d):
    return P.embed(table(spark, d, "benchmark").select("item_id", "text")).select("item_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@query("l_tumbling_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n from events group by all")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("l_session_windows", "with x as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts, b) g from x) select user_id, min(ts) as start, count(*) n from s group by user_id, g")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("l_rollup_counts", "select o_orderstatus, o_orderpriority, count(*) n from orders group by rollup (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("l_cube_counts", "select o_orderstatus, o_orderpriority, count(*) n from orders group by cube (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("l_approx_distinct", "select event_type, count(distinct user_id) exact, true as close from events group by 1")
def _(spark, d):
    # each by itself: together every pair of type and user would carry a sketch
    t = table(spark, d, "events")
    exact = t.select("event_type", "user_id").distinct().groupBy(F.col("event_type").alias("type")).agg(F.count("user_id").alias("c"))
    e = t.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a")).join(exact, F.expr("event_type <=> type"))
    return e.select("event_type", F.col("c").alias("exact"), (F.abs(F.col("a") - F.col("c")) <= 0.1 * F.col("c")).alias("close"))
