"""Retrieval queries: chunks, BM25, fusion, dense search, neighbours (groups A, F and part of B)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..sources import records as R
from .base import inline, literal, query, table, values
from .scalars import content_sql, words_sql

VARIANTS = [("raw", "the"), ("raw", "of"), ("two", "thing"), ("three", "license"), ("four", "ing"), ("four", "and")]
VSQL = values("v", "variant, word", VARIANTS)
QUESTION = "What is the thing of the license and ing"
TOK = "list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

#: Chunks of the test tables: a document is a chunk, its source the title; ten documents in a row are a paper.
CHUNKS = "ch as (select doc_id chunk_id, doc_id // 10 doc, (doc_id % 10)::int pos, lang section, source title, text from documents where trim(text) <> '')"
BM25 = f"""tk as (select chunk_id, {TOK.format(x="title")} a, {TOK.format(x="text")} b from ch), st as (select count(*) n, avg(len(a) + len(b)) av from tk),
fw as (select chunk_id, dl, word, sum(k) f from (select chunk_id, len(a) + len(b) dl, unnest(a) word, 5.0 k from tk union all select chunk_id, len(a) + len(b), unnest(b), 1.0 from tk) group by all),
df as (select word, count(*) df from fw where word in (select word from v) group by 1),
bm as (select variant, chunk_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / av))) score from fw join df using (word) join (select distinct * from v) using (word) join (select variant, count(distinct word) need from v group by 1) using (variant), st group by variant, chunk_id, need having count(*) = need),
tp as (select *, row_number() over (partition by variant order by score, chunk_id) r from bm where @scope qualify r <= 20)"""
COVER = f"cov as (select chunk_id, len(list_intersect(q, {words_sql('text')}))::double / len(q) c from ch, (select list_distinct({content_sql(literal(QUESTION))}) q))"


def _bm(scope: str = "true") -> str:
    return f"with {VSQL}, {CHUNKS}, {BM25.replace('@scope', scope)}"


def _chunks(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 10").alias("doc"), F.expr("cast(doc_id % 10 as int)").alias("pos"), F.col("lang").alias("section"), F.col("source").alias("title"), "text")
    return S.chunk_view(c)


def _vector(v, id: int):
    """The vector of a row as a column of constants; null if there is no such row."""
    found = v.where(F.col("id") == id).select("embedding").head()
    return F.lit(None).cast("array<double>") if found is None or found[0] is None else F.array(*[F.lit(float(x)) for x in found[0]])


def _variants(spark):
    return inline(spark, "variant string, word string", VARIANTS)


@query("a09_chunk_view", f"with {CHUNKS} select chunk_id, doc, pos, section, title, length(text)::int n from ch")
def _(spark, d):
    return _chunks(spark, d).select("chunk_id", "doc", "pos", "section", "title", F.length("text").alias("n"))


@query("a10_postings", f"with {CHUNKS}, tk as (select chunk_id, {TOK.format(x='title')} a, {TOK.format(x='text')} b from ch) select word, count(distinct chunk_id) df, sum(k)::double f from (select chunk_id, unnest(a) word, 5.0 k from tk union all select chunk_id, unnest(b), 1.0 from tk) group by 1")
def _(spark, d):
    return S.postings(_chunks(spark, d)).groupBy("word").agg(F.count("*").alias("df"), F.sum("f").alias("f"))


@query("f03_bm25", _bm() + " select variant, chunk_id, round(score, 6) score from bm")
def _(spark, d):
    return S.bm25(_chunks(spark, d), _variants(spark)).select("variant", "chunk_id", F.round("score", 6).alias("score"))


@query("f04_top20_per_variant", _bm() + " select variant, chunk_id, r::int r from tp")
def _(spark, d):
    return S.top_k(S.bm25(_chunks(spark, d), _variants(spark))).select("variant", "chunk_id", "r")


SCOPE = "(chunk_id in (select chunk_id from ch where section = 'en'))"


@query("b01_scoped_bm25", _bm(SCOPE) + " select variant, chunk_id, r::int r from tp")
def _(spark, d):
    return S.top_k(S.bm25(_chunks(spark, d), _variants(spark), F.col("section") == "en")).select("variant", "chunk_id", "r")


@query("b01_scope_page_in_list", "select conv_id, list_sort(list(turn)) turns from conversations group by 1 having list_contains(list(turn), 3)")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.where(F.array_contains("turns", F.lit(3).cast("long")))


@query("b01_scope_selection", "select doc_id, source from documents where doc_id in (3, 5, 8)")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isin(3, 5, 8)).select("doc_id", "source")


@query("f01_rank_fusion", _bm() + f", {COVER} select chunk_id, round(sum(1.0 / (60 + r)) + 0.05 * any_value(c), 6) fused from tp join cov using (chunk_id) group by 1")
def _(spark, d):
    ch = _chunks(spark, d)
    cover = ch.select("chunk_id", T.coverage(F.lit(QUESTION), F.col("text")).alias("coverage"))
    return S.fuse(S.top_k(S.bm25(ch, _variants(spark))), cover).select("chunk_id", F.round("fused", 6).alias("fused"))


@query("bm25_topk", _bm() + " select variant, chunk_id, round(score, 6) score, r::int r from tp")
def _(spark, d):
    return S.top_k(S.bm25(_chunks(spark, d), _variants(spark))).select("variant", "chunk_id", F.round("score", 6).alias("score"), "r")


FLAG = (
    _bm()
    + f""", {COVER}, fu as (select chunk_id, sum(1.0 / (60 + r)) + 0.05 * any_value(c) fused from tp join cov using (chunk_id) group by 1),
hit as (select *, row_number() over (order by round(fused, 9) desc, chunk_id) k from fu qualify k <= 8),
near as (select n.chunk_id, k, side, row_number() over (partition by n.chunk_id order by k, side) q from hit h join ch c using (chunk_id), (values (0, -1), (1, 1)) s(side, o) join ch n on n.doc = c.doc and n.pos = c.pos + o and n.section is not distinct from c.section where n.chunk_id not in (select chunk_id from hit) qualify q = 1),
ev as (select chunk_id, 0 kind, k, 0 side from hit union all select chunk_id, 1, k, side from near)
select chunk_id, kind = 0 is_hit, row_number() over (order by kind, k, side)::int place, round(fused, 6) fused from (select * from ev order by kind, k, side limit 24) left join (select chunk_id, fused from fu where chunk_id in (select chunk_id from hit)) using (chunk_id)"""
)


@query("f19_retrieve", FLAG)
def retrieve(spark, d):
    return S.retrieve(_chunks(spark, d), _variants(spark), QUESTION)


@query("c05_neighbours", f"with {CHUNKS}, h as (select * from ch where chunk_id % 97 = 0) select n.chunk_id doc_id, h.chunk_id rank, side from h join (values (0, -1), (1, 1)) s(side, o) on true join ch n on n.doc = h.doc and n.pos = h.pos + o and n.section is not distinct from h.section where n.chunk_id % 97 <> 0 qualify row_number() over (partition by n.chunk_id order by h.chunk_id, side) = 1")
def _(spark, d):
    c = _chunks(spark, d)
    hits = c.where("chunk_id % 97 = 0").select("chunk_id", F.col("chunk_id").alias("rank"))
    return S.neighbours(hits, c).withColumnRenamed("chunk_id", "doc_id")


@query("f02_dense_top20", "select vec_id id, round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 6) score from embeddings order by list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) desc, vec_id limit 20")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = _vector(v, 7)
    return S.dense_top_k(v, q).select("id", F.round("score", 6).alias("score"))


@query("c23_dense_in_scope", "select vec_id id, round(list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 6) score from embeddings where label = 3 order by list_inner_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) desc, vec_id limit 5")
def _(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = _vector(v, 7)
    return S.dense_top_k(v, q, 5, v.where("label = 3").select("id")).select("id", F.round("score", 6).alias("score"))


@query("g05_distinct_variants", "select p_name word, min(p_brand) source from part group by 1")
def _(spark, d):
    # each brand asks for its parts' names: the first that asks is a question's source
    return table(spark, d, "part").groupBy(F.col("p_name").alias("word")).agg(F.min("p_brand").alias("source"))


@query("b09_needs_rewrite", f"with {VSQL}, q(q) as (values ('残差'), ('plain'), ('nothinglikethis')) select q, not exists (select 1 from documents where contains(text, q)) no_match, regexp_matches(q, '[{T.CJK_NARROW}]') cjk from q")
def _(spark, d):
    q = inline(spark, "q string", [("残差",), ("plain",), ("nothinglikethis",)])
    hits = table(spark, d, "documents").select("text").join(F.broadcast(q), F.contains("text", F.col("q")), "inner").select("q").distinct().withColumn("hit", F.lit(True))
    return q.join(hits, "q", "left").select("q", F.col("hit").isNull().alias("no_match"), T.has_cjk(F.col("q")).alias("cjk"))


@query("f09_top_entities", "select event_type name, count(*) mentions from events where event_type in ('view', 'click', 'error', 'signup') group by 1 having count(*) >= 2 order by 2 desc, 1 limit 3")
def _(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click", "error", "signup")).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("mentions"))
    return e.where("mentions >= 2").orderBy(F.desc("mentions"), "name").limit(3)


@query("f21_terminology_hint", "select term from (select term, k, row_number() over (partition by lower(term) order by k) r, min(k) over (partition by lower(term)) m from (select n_name term, 1000 + n_nationkey k from nation union all select r_name, r_regionkey from region union all select 'Widget', 5000)) where r = 1 and length(term) <= 60 order by k limit 12")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("term"), (1000 + F.col("n_nationkey")).alias("k"))
    r = table(spark, d, "region").select(F.col("r_name").alias("term"), F.col("r_regionkey").alias("k"))
    t = n.unionByName(r).unionByName(inline(spark, "term string, k int", [("Widget", 5000)]))
    t = t.withColumn("r", F.row_number().over(Window.partitionBy(F.lower("term")).orderBy("k"))).where("r = 1 and length(term) <= 60")
    return t.orderBy("k").limit(12).select("term")


@query("e14_rank_labels", _bm() + " select chunk_id, 'E' || row_number() over (order by score, chunk_id) label from (select chunk_id, min(score) score from tp group by 1)")
def _(spark, d):
    t = S.top_k(S.bm25(_chunks(spark, d), _variants(spark))).groupBy("chunk_id").agg(F.min("score").alias("score"))
    return t.select("chunk_id", F.concat(F.lit("E"), F.row_number().over(Window.orderBy("score", "chunk_id")).cast("string")).alias("label"))


@query("e17_decode_lists", "select doc_id, [3, doc_id % 5]::int[] pages, true is_hit from documents")
def _(spark, d):
    s = F.concat(F.lit(",3,"), (F.col("doc_id") % 5).cast("string"), F.lit(","))
    return table(spark, d, "documents").select("doc_id", F.split(F.btrim(s, F.lit(",")), ",").cast("array<int>").alias("pages"), F.lit(True).alias("is_hit"))


@query("a27_collect_urls", "select page_id, case when page_id % 3 = 0 then [url] when page_id % 3 = 1 then [url, url || '/b'] else list_sort([url, 'http://h/' || page_id]) end urls from pages")
def _(spark, d):
    p = table(spark, d, "pages")
    other = F.when(F.col("page_id") % 3 == 0, "ftp://x").when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/b"))).otherwise(F.concat(F.lit("http://h/"), F.col("page_id").cast("string")))
    deep = F.array(F.struct(other.alias("uri"), F.array(F.array(F.struct(F.col("url").alias("link"), F.array(F.lit("http://no.key")).alias("url")))).alias("deep")))
    j = F.to_json(F.struct(F.struct("url", F.lit("http://no.name").alias("title")).alias("a"), deep.alias("b")))
    return R.collected_urls(p.select(F.col("page_id").alias("id"), j.alias("value"))).select(F.col("id").alias("page_id"), "urls")
