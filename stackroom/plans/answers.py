"""Questions, replies, calls, contexts, artifacts and stored records (the rest of groups A, B, C, F, H, I, J, K)."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import providers as P
from ..functions import spans as SP
from ..functions import text as T
from ..operators import answers as A
from ..operators import linking as L
from ..operators import search as S
from ..operators import selection as SEL
from ..operators import shared
from ..operators import store as ST
from ..operators import structure as X
from ..sources import records as R
from ..streaming import jobs
from .base import LINES, dealt, inline, literal, paragraphs, query, table, values
from .library import NORM
from .retrieval import FLAG, QUESTION, _bm, _chunks, _variants
from .scalars import TOK, words_sql
from .structure import BLOCKS, _blocks

# questions

GLOSSARY = [(0, "thing", "chose"), (1, "in the", "dans le"), (2, "the", "le"), (3, "nothing", ""), (4, "tion", "ation"), (5, "at", "de la")]
ACRONYMS = [(0, "one", "on a"), (1, "nd", "and"), (2, "xyz", None), (3, "er", "there")]
ENTITIES = [("Alpha", "the", 5), ("beta", "the", 4), ("Beta2", "the", 4), ("Gamma", "the", 2), ("Rare", "the", 1), ("Omega", "of", 3), (" ", "of", 9), ("Delta", "la", 3)]


@query(
    "h15_expand",
    f"""with {values('g', 'pos, s, t', GLOSSARY)}, {values('a', 'pos, s, t', ACRONYMS)}, {values('e', 'name, kind, n', ENTITIES)},
c as (select t term, s expansion, 'glossary' source, [-length(t), 0, pos, 0] ord from g where t <> '' union all select s, t, 'glossary', [-length(s), 0, pos, 1] from g where t <> '' union all select s, t, 'acronym', [-length(s), 1, pos, 0] from a where t <> '' union all select t, s, 'acronym', [-length(t), 1, pos, 1] from a where t <> ''),
m as (select item_id qid, c.*, trim(lower(term)) needle from benchmark, c where length(trim(lower(term))) >= 2 and contains(lower(text), trim(lower(term)))),
k as (select * from m x where not exists (select 1 from m y where y.qid = x.qid and y.ord < x.ord and contains(y.needle, x.needle))),
w as (select item_id qid, {words_sql('text')} w from benchmark), named as (select qid, list_distinct(list_concat(w, list_transform(w, lambda x: case when x like '%s' and length(x) > 3 then x[:-2] else x end))) w from w),
r as (select qid, name, row_number() over (partition by qid order by n desc, lower(name), name) r from named join e on list_contains(w, kind) where n >= 2 and trim(name) <> '' qualify r <= 3)
select qid, (row_number() over (partition by qid order by ord) - 1)::int place, term, expansion, source from k union all select qid, (r + 999)::int, name, name, 'entity' from r""",
)
def _(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))
    g = inline(spark, "pos int, source_term string, translation string", GLOSSARY)
    a = inline(spark, "pos int, acronym string, expansion string", ACRONYMS)
    return A.expand(q, g, a, inline(spark, "name string, kind string, mentions int", ENTITIES))


REPLIES = [
    '{"status": "answered", "answer": "Claim {c} [E{t}]", "unanswered_aspects": []}',
    '```json\n{"status": "partial", "answer": "Half of {c} [E1]", "unanswered_aspects": ["the rest {t}"]}\n```',
    'Here it is: {"status": "answered", "answer": "After words [E2] {c}"} so',
    '{"status": "partial", "answer": "x [E1]", "unanswered_aspects": [" "]}',
    '{"status": "answered", "answer": "no marker {c}"}',
    '{"status": "insufficient_evidence"}',
    '{"status": "sure", "answer": "[E1]"}',
    "[1, {t}]",
    "{not json {c}}",
    "   ",
    '{"status": "answered", "answer": 5}',
    '{"status": "answered", "answer": "y [E1]", "unanswered_aspects": [1, "a"]}',
    '{"status": "answered", "answer": "  "}',
    '{"answer": "z [E1]"}',
]
REPLY_SQL = f"""with {values('tpl', 'k, t', list(enumerate(REPLIES)))}, r as (select conv_id, turn, replace(replace(t, '{{c}}', conv_id::varchar), '{{t}}', turn::varchar) reply from conversations join tpl on k = (conv_id * 7 + turn) % {len(REPLIES)}),
f as (select *, case when starts_with(trim(reply), '```') then trim(regexp_replace(regexp_replace(trim(reply), '^[^\\n]*\\n', ''), '```\\s*$', '')) else trim(reply) end c from r),
j as (select *, case when json_valid(c) then c when json_valid(regexp_extract(c, '(?s)(\\{{.*\\}})', 1)) then regexp_extract(c, '(?s)(\\{{.*\\}})', 1) end j from f),
v as (select *, j ->> '$.status' status, j ->> '$.answer' answer, case when json_type(j, '$.unanswered_aspects') = 'ARRAY' then from_json(j -> '$.unanswered_aspects', '["json"]') else [] end asp from j),
p as (select *, case when trim(reply) = '' then 'empty' when j is null then 'not_json' when json_type(j) <> 'OBJECT' then 'not_object' when json_type(j, '$.status') is distinct from 'VARCHAR' or status not in ('answered', 'partial', 'insufficient_evidence') then 'bad_status'
 when coalesce(json_type(j, '$.answer'), 'VARCHAR') <> 'VARCHAR' then 'answer_not_text' when len(list_filter(asp, lambda x: json_type(x) <> 'VARCHAR')) > 0 then 'aspects_not_texts' when status = 'insufficient_evidence' then '' when trim(coalesce(answer, '')) = '' then 'empty_answer'
 when not regexp_matches(answer, '\\[E[0-9]+\\]') then 'no_evidence_cited' when status = 'partial' and len(list_filter(asp, lambda x: trim(x ->> '$') <> '')) = 0 then 'no_aspect_named' else '' end problem from v)"""


def _replies(spark, d):
    t = inline(spark, "k int, t string", list(enumerate(REPLIES)))
    c = table(spark, d, "conversations").withColumn("k", ((F.col("conv_id") * 7 + F.col("turn")) % len(REPLIES)).cast("int"))
    r = F.replace(F.replace("t", F.lit("{c}"), F.col("conv_id").cast("string")), F.lit("{t}"), F.col("turn").cast("string"))
    return c.join(F.broadcast(t), "k").select("conv_id", "turn", r.alias("reply"))


@query("j04_parse_reply", REPLY_SQL + " select conv_id, turn, case when problem = '' then status end status, case when problem = '' then coalesce(answer, '') end answer, case when problem = '' then len(asp)::int end aspects, problem from p")
def _(spark, d):
    r = _replies(spark, d).withColumn("p", A.parse_reply(F.col("reply")))
    return r.select("conv_id", "turn", "p.status", "p.answer", F.when(F.col("p.aspects").isNotNull(), F.size("p.aspects")).alias("aspects"), "p.problem")


def repair_known(prompt: str) -> str:
    """A stand-in: its first reply is the prompt, a repair mends what lacked evidence."""
    return '{"status": "answered", "answer": "Mended [E1]"}' if prompt.endswith("problem: no_evidence_cited") else prompt


@query(
    "j05_checked_answers",
    REPLY_SQL + " select conv_id, turn, case when problem = '' and (status = 'insufficient_evidence' or not regexp_matches(answer, '\\[E([2-9]|1[0-9])\\]') or turn < 2) and not (status <> 'insufficient_evidence' and regexp_matches(answer, '\\[E0\\]')) then status when problem = 'no_evidence_cited' then 'answered' else 'insufficient_evidence' end status from p where not regexp_matches(reply, '\\[E(0|[2-9]|1[0-9])\\]')",
)
def _(spark, d):
    r = _replies(spark, d).where(~F.col("reply").rlike(r"\[E(0|[2-9]|1[0-9])\]"))
    q = r.select("conv_id", "turn", F.col("reply").alias("prompt"), F.array(F.lit("E1")).alias("markers"))
    return A.ask(q, repair_known).select("conv_id", "turn", "status")


@query("j05_answer", f"select {literal(QUESTION)} question, 'answered' status, 'See [E1].' answer, 'OK' code, list(chunk_id order by place) evidence, false rewritten from (select chunk_id, place, sum(length(text)) over (order by place) used from ({FLAG}) join documents on chunk_id = doc_id) where used <= 24000 or place = 1")
def _(spark, d):
    return A.answer(spark, _chunks(spark, d), _variants(spark), QUESTION, A.cite_first)


# the stored index


def _index(spark, d, version: str = "1", force: bool = False) -> tuple[str, bool, object]:
    path = f"{shared.folder(spark)}/index-{d.rstrip('/').rsplit('/', 1)[-1]}"
    chunks = _chunks(spark, d)
    files = table(spark, d, "documents").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("m")).distinct()
    content = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "p", "s", "m"))), "\n"), 256)).head()[0]
    return path, S.ensure_index(spark, path, chunks, content, version, force), chunks


@query("a10_index_rebuild", "with n as (select count(*) n from documents where trim(text) <> '') select step, rebuilt, n from n, (values ('first', true), ('again', false), ('new version', true)) v(step, rebuilt)")
def _(spark, d):
    steps = [("first", _index(spark, d, "1", True)), ("again", _index(spark, d, "1")), ("new version", _index(spark, d, "2"))]
    n = S.read_index(spark, steps[0][1][0])[1].select(F.col("n_chunks").alias("n"))
    return inline(spark, "step string, rebuilt boolean", [(k, x[1]) for k, x in steps]).join(F.broadcast(n))


@query("f03_block_max", _bm() + " select variant, chunk_id, round(score, 6) score, r::int r from tp")
def _(spark, d):
    path, _, _ = _index(spark, d)
    return S.block_max_top_k(spark, path, _variants(spark)).select("variant", "chunk_id", F.round("score", 6).alias("score"), "r")


@query("f03_bm25_indexed", _bm() + " select variant, chunk_id, round(score, 6) score from bm")
def _(spark, d):
    path, _, chunks = _index(spark, d)
    return S.bm25(chunks, _variants(spark), index=path).select("variant", "chunk_id", F.round("score", 6).alias("score"))


# contexts, targets, selections, the reading column


@query(
    "c25_unit_contexts",
    f"with {LINES}, p as (select doc_id doc, pos id, {NORM.format(x='text')} t from para), u as (select doc, id, case when id % 2 = 0 then t[1:greatest(45, length(t) // 2)] else t end t from p), s as (select u.doc, u.id, u.t, p.id pid, case when contains(p.t, u.t) then 1.0 when contains(u.t, p.t) then length(p.t)::double / length(u.t) else len(list_intersect(list_distinct(string_split(u.t, ' ')), string_split(p.t, ' ')))::double / len(list_distinct(string_split(u.t, ' '))) end sc from u join p on u.doc = p.doc and p.t <> ''), b as (select doc, id, max(sc) best from s group by all), r as (select doc, id, count(*) c, min(pid) pid, any_value(best) best from s join b using (doc, id) where sc = best group by all), z as (select u.doc, u.id, u.t, case when length(u.t) >= 40 and best >= 0.8 and c = 1 and pid % 3 <> 0 then pid end pid from u left join r using (doc, id)) select doc, id unit, pid paragraph, 'context of ' || pid context, case when pid is null then 'UNMAPPED' end fallback, sha256(sha256('v1' || chr(1) || coalesce('context of ' || pid, '')) || chr(0) || t) as \"key\" from z",
)
def _(spark, d):
    p = paragraphs(spark, d).select(F.col("doc_id").alias("doc"), F.col("pos").alias("paragraph"), T.normalize_unit(F.col("text")).alias("text"))
    u = p.select("doc", F.col("paragraph").alias("unit"), F.when(F.col("paragraph") % 2 == 0, F.substring("text", F.lit(1), F.greatest(F.lit(45), F.floor(F.length("text") / 2)).cast("int"))).otherwise(F.col("text")).alias("text"))
    context = p.where("paragraph % 3 <> 0").select("doc", "paragraph", F.concat(F.lit("context of "), F.col("paragraph").cast("string")).alias("context"))
    return L.unit_contexts(u, p, context, "v1", normalized=True)


CANON = "trim(regexp_replace({x}, '[\\t ]+', ' ', 'g'))"
STATES = f"""with {BLOCKS}, t as (select doc, pos, page, layout, {CANON.format(x='substr(text, 3, 30)')} needle from bl),
c as (select t.doc, t.pos, count(p.pos) filter (contains({CANON.format(x='p.text')}, needle)) h, count(p.pos) filter (t.layout = 'plain text' and trim(p.text) <> '' and contains(needle, {CANON.format(x='p.text')})) w from t left join bl p on p.doc = t.doc and p.page = t.page and p.layout = t.layout and needle <> '' group by all),
s as (select doc, pos, layout, case when pos % 3 = 0 then 'EXACT' when h = 1 then 'REATTACHED' when h > 1 then 'AMBIGUOUS' when w = 1 then 'REATTACHED' when w > 1 then 'AMBIGUOUS' else 'ORPHANED' end state from t join c using (doc, pos))"""


def _resolved(spark, d):
    b = _blocks(spark, d).withColumn("id", F.concat_ws("_", "doc", "pos")).withColumn("anchor", F.sha2("id", 256))
    t = b.select(F.col("id").alias("target"), F.when(F.col("pos") % 3 == 0, F.col("anchor")).otherwise("gone").alias("anchor"), "doc", "page", "layout", F.substring("text", 3, 30).alias("quote"))
    cols = ["id", "anchor", "doc", "page", "text"]
    r = X.resolve_targets(t, b.where("layout = 'plain text'").select(*cols), b.where("layout <> 'plain text'").select(*cols, "layout"), ("title", "figure"))
    return r.select(F.split("target", "_")[0].cast("long").alias("doc"), F.split("target", "_")[1].cast("int").alias("pos"), "state")


@query("c09_resolve_targets", STATES + " select doc, pos, state from s")
def _(spark, d):
    return _resolved(spark, d)


@query("c26_changed_states", STATES + " select doc, pos, state from s where state <> case when pos % 2 = 0 then 'EXACT' else 'REATTACHED' end")
def _(spark, d):
    old = F.when(F.col("pos") % 2 == 0, "EXACT").otherwise("REATTACHED")
    return _resolved(spark, d).where(~F.col("state").eqNullSafe(old))


@query(
    "c16_selected_blocks",
    f"with {BLOCKS}, g as (select *, (pos % 2) * 300.0 x0, (pos % 2) * 300.0 + 280 x1, (pos % 8) * 20.0 y0, (pos % 8) * 20.0 + 18 y1 from bl where layout <> 'plain text'), i as (select *, greatest(0, least(290.0, x1) - greatest(10.0, x0)) dx, greatest(0, least(75.0, y1) - greatest(15.0, y0)) dy from g where page = 1) select doc, pos from i where dx >= 4 and dy / least(60, y1 - y0) >= 0.5 and dx * dy >= least(80.0, 0.4 * 280 * 60) and contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the')",
)
def _(spark, d):
    b = _blocks(spark, d).where("layout <> 'plain text'")
    b = b.select("doc", "page", F.concat_ws("_", "doc", "pos").alias("id"), "text", ((F.col("pos") % 2) * 300.0).alias("x0"), ((F.col("pos") % 2) * 300.0 + 280).alias("x1"), ((F.col("pos") % 8) * 20.0).alias("y0"), ((F.col("pos") % 8) * 20.0 + 18).alias("y1"))
    rects = b.select("doc").distinct().select("doc", F.lit(1).alias("page"), F.lit(10.0).alias("x0"), F.lit(290.0).alias("x1"), F.lit(15.0).alias("y0"), F.lit(75.0).alias("y1"))
    return SEL.selected_blocks(rects, b, F.lit("the")).select("doc", F.split("id", "_")[1].cast("int").alias("pos"))


@query(
    "c15_selected_on_lines",
    f"with {BLOCKS}, g as (select *, (pos % 2) * 300.0 x0, (pos % 2) * 300.0 + 280 x1, (pos % 8) * 20.0 y0, (pos % 8) * 20.0 + 18 y1 from bl where layout = 'plain text'), i as (select *, greatest(0, least(290.0, x1) - greatest(10.0, x0)) dx, greatest(0, least(33.0, y1) - greatest(5.0, y0)) dy from g where page = 1) select doc, pos from i where dx >= 4 and dy >= 0.5 * 18 and dx * dy >= 80 and contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'the')",
)
def _(spark, d):
    b = _blocks(spark, d).where("layout = 'plain text'")
    b = b.select("doc", "page", F.concat_ws("_", "doc", "pos").alias("id"), "text", ((F.col("pos") % 2) * 300.0).alias("x0"), ((F.col("pos") % 2) * 300.0 + 280).alias("x1"), ((F.col("pos") % 8) * 20.0).alias("y0"), ((F.col("pos") % 8) * 20.0 + 18).alias("y1"))
    rects = b.select("doc").distinct().select("doc", F.lit(1).alias("page"), F.lit(10.0).alias("x0"), F.lit(290.0).alias("x1"), F.lit(5.0).alias("y0"), F.lit(33.0).alias("y1"))
    return SEL.selected(rects, b, F.lit("the")).select(F.split("id", "_")[0].cast("long").alias("doc"), F.split("id", "_")[1].cast("int").alias("pos"))


@query(
    "c17_reflow",
    f"""with {BLOCKS}, c as (select *, lag(layout) over (partition by doc order by pos) before from bl), b as (select doc, pos, case when layout = 'plain text' and before = 'figure' and pos % 3 = 0 then 'figure_caption' else layout end layout, text, case when layout = 'plain text' and before = 'figure' and pos % 3 = 0 then pos - 1 end cap from c),
p as (select doc, pos, text, max(case when layout = 'title' then pos end) over (partition by doc order by pos) sec, layout from b),
e as (select doc, pos, 1 k, 'heading' kind, 'h_' || pos id, text, null translated from b where layout = 'title' union all select f.doc, f.pos, 1, 'crop', 'c_' || f.pos, g.text, null from b f left join b g on g.doc = f.doc and g.cap = f.pos where f.layout = 'figure'
 union all select doc, pos, 1, 'pair', 'p_' || pos, text, case when pos % 2 = 0 then 'T' || pos end from p where layout = 'plain text' union all select doc, min(pos), 0, 'notice', 'n_' || sec, '', null from p where layout = 'plain text' and sec % 13 = 0 group by doc, sec)
select doc, row_number() over (partition by doc order by pos, k, kind, id)::int place, kind, id, text, translated from e""",
)
def _(spark, d):
    w = Window.partitionBy("doc").orderBy("pos")
    cap = (F.col("layout") == "plain text") & (F.lag("layout").over(w) == "figure") & (F.col("pos") % 3 == 0)
    b = _blocks(spark, d).withColumn("cap", F.coalesce(cap, F.lit(False)))
    b = b.select("doc", "pos", "page", "text", F.when(F.col("cap"), "figure_caption").otherwise(F.col("layout")).alias("layout"), F.when(F.col("cap"), F.col("pos") - 1).alias("caption_of"))
    text = lambda c: F.col(c).cast("string")
    p = b.withColumn("section", F.max(F.when(F.col("layout") == "title", F.col("pos"))).over(w)).where("layout = 'plain text'")
    p = p.select("doc", text("pos").alias("id"), F.col("pos").alias("first_pos"), text("section").alias("section"), "text")
    s = b.where("layout = 'title'").select("doc", text("pos").alias("section"), F.col("pos").alias("heading_pos"), F.col("text").alias("title"), (F.col("pos") % 13 == 0).alias("is_references"))
    return X.reflow(b, p, s, p.where("first_pos % 2 = 0").select("doc", "id", F.concat(F.lit("T"), "id").alias("translated")))


COLUMNS = "bx as (select doc_id doc, pos, 72.0 + (pos % 2) * 250 + length(text) % 7 x0, 72.0 + (pos % 2) * 250 + 200 + length(text) % 31 x1 from para)"


@query(
    "f06_column_split",
    f"""with {LINES}, {COLUMNS}, g as (select doc, min(x0) l, max(x1) r, max(x1) - min(x0) w, count(*) n from bx group by 1 having max(x1) > min(x0) and count(*) >= 2), b as (select bx.*, l, w from bx join g using (doc) where x1 - x0 >= greatest(10.0, 0.02 * w) and x1 - x0 < 0.9 * w),
m as (select doc, any_value(l) l, any_value(w) w, count(*) n from b group by 1 having count(*) >= 4), k as (select m.*, c, (select count(*) from b where b.doc = m.doc and c >= greatest(0, floor((x0 - b.l) / b.w * 200)) and c < least(200, greatest(floor((x1 - b.l) / b.w * 200 + 0.5), floor((x0 - b.l) / b.w * 200) + 1))) k from m, range(40, 160) r(c)),
lo as (select *, min(k) over (partition by doc) lowest from k), q as (select *, c - row_number() over (partition by doc order by c) run from lo where k = lowest and lowest <= greatest(1, floor(0.35 * n))), u as (select doc, l, w, run, min(c) a, max(c) + 1 z from q group by all)
select doc, round(l + (a + z) / 2 / 200 * w, 6) gutter from u where (z - a) / 200 * w >= 6 or true qualify row_number() over (partition by doc order by z - a desc, a) = 1 and (z - a) / 200 * w >= 6""",
)
def _(spark, d):
    p = paragraphs(spark, d).withColumn("x0", 72.0 + (F.col("pos") % 2) * 250 + F.length("text") % 7).withColumn("x1", 72.0 + (F.col("pos") % 2) * 250 + 200 + F.length("text") % 31)
    return X.column_split(p.select(F.col("doc_id").alias("doc"), "x0", "x1"), ["doc"]).select("doc", F.round("gutter", 6).alias("gutter"))


@query("f07_columns_in_bands", f"with {LINES}, n as (select doc_id doc, pos, count(*) over (partition by doc_id) n from para) select doc, pos, row_number() over (partition by doc order by case when pos = 0 then 0 when n < 5 then 1 else 1 + pos % 2 end, pos // 2, pos % 2)::int rank from n")
def _(spark, d):
    # a banner, then two columns; fewer than four blocks below it are one column
    p = paragraphs(spark, d).select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "pos", F.lit("plain text").alias("layout"))
    first = F.col("pos") == 0
    x0 = F.when(first, 72.0).otherwise(72.0 + (F.col("pos") % 2) * 250)
    p = p.withColumn("x0", x0).withColumn("x1", F.when(first, 530.0).otherwise(x0 + 208)).withColumn("y0", F.when(first, 0.0).otherwise(F.expr("(pos div 2) * 20.0 + 40")))
    return X.reading_order(p).select("doc", "pos", "rank")


# artifacts and stored records

IDENTITY = {"artifact_kind": "overview", "schema_version": 3, "pipeline_version": "p2", "prompt_version": "r5", "content_hash": "h", "target_language": "de", "ir_pipeline_version": "i7"}


def _artifacts(spark, d, identity: dict):
    """Every document has an artifact; of some one part of the identity is another."""
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 17 == 3, "FAILED").otherwise("READY").alias("status"))
    for i, (k, v) in enumerate(identity.items()):
        t = t.withColumn(k, F.when(F.col("doc_id") % 11 == i, F.lit(None)).otherwise(F.lit(v)))
    return t


@query("b25_overview_valid", "select doc_id, doc_id % 17 <> 3 and doc_id % 11 not in (0, 1, 2, 3, 4, 5, 6) valid from documents")
def _(spark, d):
    return _artifacts(spark, d, IDENTITY).select("doc_id", ST.compatible(IDENTITY, F.col("status").isin("READY", "PARTIAL")).alias("valid"))


@query("b26_formulas_valid", "select doc_id, doc_id % 17 <> 3 and doc_id % 11 not in (0, 1, 2, 3, 4, 5) valid from documents")
def _(spark, d):
    identity = {k: v for k, v in IDENTITY.items() if k != "target_language"}
    return _artifacts(spark, d, identity).select("doc_id", ST.compatible(identity, F.col("status").isin("READY", "PARTIAL")).alias("valid"))


@query("k19_point_lookup", "select o_orderkey, o_orderstatus from orders where o_orderkey = 32")
def _(spark, d):
    return ST.one(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") == 32)


@query("a08_stored_records", "select doc_id, source, n_chars from documents where doc_id % 7 <> 0")
def _(spark, d):
    path = f"{shared.folder(spark)}/records-{shared.uuid.uuid4().hex}"
    good = F.to_json(F.struct("doc_id", "source", "n_chars"))
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"doc_id": '), F.col("source"))).otherwise(good).alias("value")).write.text(path)
    return R.read_records(spark, path, "doc_id long, source string, n_chars long")


@query("k15_keyed_artifacts", "select n_nationkey, case when n_regionkey = 1 then 'second' else 'first' end written, n_regionkey from nation")
def _(spark, d):
    path = f"{shared.folder(spark)}/keyed-{shared.uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    R.write_keyed(n.withColumn("written", F.lit("first")), path, "n_regionkey")
    R.write_keyed(n.where("n_regionkey = 1").withColumn("written", F.lit("second")), path, "n_regionkey")
    return spark.read.parquet(path)


_UNITS = f"with {LINES}, b as (select doc_id id, page, (row_number() over (partition by doc_id, page order by pos) - 1)::int k, pos, text, trim(regexp_replace(text, '[\\t ]+', ' ', 'g'), ' ' || chr(9)) t from para)"


def _json(c):
    """A value as JSON text."""
    return F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)


def _object(**fields):
    return F.concat(F.lit("{"), *[y for k, v in enumerate(fields.items()) for y in (F.lit(f'{", " * (k > 0)}"{v[0].rstrip("_")}": '), v[1])], F.lit("}"))


def _list(*xs):
    return F.concat(F.lit("["), F.concat_ws(", ", *xs), F.lit("]"))


def _pages(p, block, name: str, top: str):
    """Documents as parser JSON whose blocks are the lines."""
    page = p.groupBy("doc_id", "page").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x.b), ", "), F.lit("]")).alias("b"))
    page = page.select("doc_id", "page", _object(page_idx=(F.col("page") - 1).cast("string"), **{name: F.col("b")}).alias("p"))
    doc = page.groupBy(F.col("doc_id").alias("id")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "p"))), lambda x: x.p), ", "), F.lit("]")).alias("pages"))
    return doc.select("id", _object(**{top: F.col("pages")}).alias("value"))


def _v4_documents(spark, d):
    """Every line is a block: by its place titles, text with styles, lists three deep, tables with caption and footnote, unknown kinds."""
    p = paragraphs(spark, d)
    t, k = F.col("text"), F.col("pos") % 7
    lit = lambda x: F.lit(f'"{x}"')
    text = _object(type=lit("text"), content=_json(t))
    half = F.floor(F.length("text") / 2).cast("int")
    spans = _list(_object(type=lit("text"), content=_json(F.substring(t, F.lit(1), half))), _object(type=lit("text"), content=_json(F.substring(t, half + 1, F.length("text"))), styles=F.lit('["bold"]')))
    deep = _object(type=lit("list"), content=_list(_object(type=lit("list"), content=_list(_object(type=lit("text"), content=lit("inner")), F.lit("7"))), _object(type=lit("ref_text"), content=lit("cited"))))
    block = (
        F.when(k == 0, _object(type=lit("paragraph_title"), level=F.lit("3"), content=_json(t)))
        .when(k == 1, _object(type=lit("text"), content=spans, continues_prev=F.lit("true"), bbox=F.lit("[0, 0.5, 1, 0.75]")))
        .when(k == 2, _object(type=lit("list"), continues_prev=F.lit("true"), content=_list(_object(type=lit("text"), content=_json(t)), deep, _object(type=lit("text"), content=lit("last")))))
        .when(k == 3, _object(type=lit("table"), content=_list(_object(type=lit("table_caption"), content=_json(t)), _object(type=lit("table_body"), content=lit("<table></table>"), image_path=lit("t.png")), _object(type=lit("table_footnote"), content=lit("note")), _object(type=lit("other"), content=lit("x")))))
        .when(k == 4, _object(type=lit("page_number"), content=_json(t)))
        .when(k == 5, _object(type=lit("never heard of"), content=_json(t)))
        .otherwise(text)
    )
    return _pages(p, block, "blocks", "pages")


_V4 = "select id, page, k, unnest(case pos % 7 when 0 then [(0, 'heading', 'title', 2, t, null, false, false)] when 1 then [(0, 'text', 'plain text', null, t, null, false, true)] when 2 then [(0, 'text', 'plain text', null, t, null, false, true), (1, 'text', 'plain text', null, 'inner', null, false, false), (2, 'ref', 'plain text', null, 'cited', null, false, false), (3, 'text', 'plain text', null, 'last', null, false, false)] when 3 then [(0, 'table_caption', 'table_caption', null, t, page || '-' || k, false, false), (1, 'table', 'table', null, '', page || '-' || k, true, false), (2, 'table_footnote', 'table_footnote', null, 'note', page || '-' || k, false, false)] when 4 then [(0, 'abandon', 'abandon', null, t, null, false, false)] when 5 then [] else [(0, 'text', 'plain text', null, t, null, false, false)] end) u from b"


@query("a04_flatten_v4", f"{_UNITS}, u as ({_V4}) select id, page, (row_number() over (partition by id, page order by k, u[1]) - 1)::int pos, u[2] kind, u[3] layout, u[4]::int as level, u[5] as text, u[6] visual, u[7] is_body, u[8] continues, case when u[2] = 'table' then '<table></table>' end html from u")
def _(spark, d):
    return R.blocks(_v4_documents(spark, d)).select("id", "page", "pos", "kind", "layout", "level", "text", "visual", "is_body", "continues", "html")


def _legacy_documents(spark, d):
    p = paragraphs(spark, d)
    t, k = F.col("text"), F.col("pos") % 6
    lit = lambda x: F.lit(f'"{x}"')
    half = F.floor(F.length("text") / 2).cast("int")
    line = _object(spans=_list(_object(type=lit("text"), content=_json(F.substring(t, F.lit(1), half))), _object(type=lit("text"), content=_json(F.substring(t, half + 1, F.length("text"))))))
    word = lambda x: _object(spans=_list(_object(type=lit("text"), content=lit(x))))
    block = (
        F.when(k == 0, _object(type=lit("title"), level=F.lit("1"), lines=_list(line)))
        .when(k == 1, _object(type=lit("list"), blocks=_list(_object(type=lit("text"), lines=_list(line)), _object(type=lit("text"), lines=_list(word("recog-"), word("nition"), word("Next"), word("漢"), word("字"))))))
        .when(k == 2, _object(type=lit("interline_equation"), lines=_list(_object(spans=_list(_object(type=lit("interline_equation"), content=lit("E=mc")))))))
        .when(k == 3, _object(type=lit("image"), blocks=_list(_object(type=lit("image_body"), lines=_list(_object(spans=_list(_object(type=lit("image"), image_path=lit("i.png")))))), _object(type=lit("image_caption"), lines=_list(line)))))
        .when(k == 4, _object(type=lit("text"), lines_deleted=F.lit("true"), lines=F.lit("[]")))
        .otherwise(_object(type=lit("text"), bbox=F.lit("[1, 2, 3, 4]"), lines=_list(line)))
    )
    return _pages(p, block, "para_blocks", "pdf_info")


_LEGACY = "select id, page, k, unnest(case pos % 6 when 0 then [(0, 'heading', 'title', t, null, null)] when 1 then [(0, 'text', 'plain text', t, null, null), (1, 'text', 'plain text', 'recognition Next 漢字', null, null)] when 2 then [(0, 'equation', 'isolate_formula', 'E=mc', null, null)] when 3 then [(0, 'figure', 'figure', '', page || '-' || k, 'i.png'), (1, 'figure_caption', 'figure_caption', t, page || '-' || k, null)] when 4 then [] else [(0, 'text', 'plain text', t, null, null)] end) u from b"


@query("a05_flatten_legacy", f"{_UNITS}, u as ({_LEGACY}) select id, page, (row_number() over (partition by id, page order by k, u[1]) - 1)::int pos, u[2] kind, u[3] layout, u[4] as text, u[5] visual, u[6] image_path from u")
def _(spark, d):
    return R.blocks(_legacy_documents(spark, d)).select("id", "page", "pos", "kind", "layout", "text", "visual", "image_path")


@query("a03_parser_json", f"{_UNITS}, u as ({_V4}), v as ({_LEGACY}) select id, 'v4' dialect, u[2] kind, count(*) n, sum(length(u[5]))::bigint chars from u group by all union all select id, 'legacy', u[2], count(*), sum(length(u[4]))::bigint from v group by all")
def _(spark, d):
    # both dialects in one table, beside what is neither
    raw = _v4_documents(spark, d).select("id", F.lit("v4").alias("dialect"), "value").unionByName(_legacy_documents(spark, d).select("id", F.lit("legacy").alias("dialect"), "value"))
    raw = raw.unionByName(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("none").alias("dialect"), F.concat(F.lit('{"pages": '), "n_name").alias("value")))
    u = R.blocks(raw.select(F.struct("id", "dialect").alias("id"), "value"))
    return u.groupBy("id.id", "id.dialect", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("a26_second_work", "select 'S' || p_partkey as \"key\", p_name title, [p_brand] authors, 2000 + p_size as \"year\", nullif(case when p_size % 2 = 0 then p_type else '' end, '') venue, case when p_size % 3 = 0 then '10.1/' || p_partkey end doi, p_size cited_by, case when p_size % 5 = 0 then 'http://x/' || p_partkey end oa_pdf_url from part")
def _(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    s = F.col("p_size")
    raw = F.struct(F.concat(F.lit("S"), k).alias("paperId"), F.col("p_name").alias("title"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"), (2000 + s).alias("year"), F.when(s % 2 == 0, F.col("p_type")).otherwise("").alias("venue"), F.struct(F.when(s % 3 == 0, F.concat(F.lit("10.1/"), k)).alias("DOI")).alias("externalIds"), s.alias("citationCount"), F.struct(F.when(s % 5 == 0, F.concat(F.lit("http://x/"), k)).otherwise("").alias("url")).alias("openAccessPdf"))
    return R.second_work_of(p.select(F.to_json(raw).alias("value"))).drop("url", "abstract")


@query(
    "h36_found_works",
    "with r as (select p_partkey, case when p_size % 9 = 0 then 'ab' else p_name || ' ' || p_partkey end title, case p_size % 4 when 0 then 'https://doi.org/10.1234/x' || p_partkey when 1 then 'doi:10.1234/x' || p_partkey when 2 then 'bad' else '' end doi, case p_size % 3 when 0 then 'http://h.org/' || p_partkey when 1 then 'ftp://no' else '' end url from part), c as (select p_partkey, trim(title) title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) plain, nullif(regexp_extract(doi, '10\\.1234/x[0-9]+'), '') doi, url from r where length(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) >= 4) select 'web_' || sha1(lower(coalesce(doi, plain)))[1:12] as \"key\", title, ['A. One', 'B. Two'] authors, doi, coalesce(case when url like 'http%' then url end, 'https://doi.org/' || doi) url, coalesce(url = 'http://h.org/7' or contains('https://doi.org/10.1234/x8', doi), false) verified from c",
)
def _(spark, d):
    p = table(spark, d, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    doi = F.when(s % 4 == 0, F.concat(F.lit("https://doi.org/10.1234/x"), k)).when(s % 4 == 1, F.concat(F.lit("doi:10.1234/x"), k)).when(s % 4 == 2, "bad").otherwise("")
    url = F.when(s % 3 == 0, F.concat(F.lit("http://h.org/"), k)).when(s % 3 == 1, "ftp://no").otherwise("")
    raw = F.struct(F.when(s % 9 == 0, "ab").otherwise(F.concat("p_name", F.lit(" "), k)).alias("title"), doi.alias("doi"), url.alias("url"), F.lit("A. One; B. Two").alias("authors"), F.lit("n.d.").alias("year"))
    return R.found_work_of(p.select(F.to_json(raw).alias("value")), ["http://h.org/7", "https://doi.org/10.1234/x8"]).select("key", "title", "authors", "doi", "url", "verified")


@query("a20_styled_spans", "with w as (select item_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w from benchmark), o as (select item_id, w, list_transform(range(1, len(w) + 1), lambda i: coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x) + 1)), 0)::bigint) s from w) select item_id, array_to_string(w, ' ') as text, list_transform(list_filter(range(1, len(w) + 1), lambda i: i % 3 = 1), lambda i: s[i] || '-' || (s[i] + length(w[i]))) runs from o")
def _(spark, d):
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    span = lambda x, i: F.struct(F.lit("text").alias("type"), F.concat(x, F.lit(" \t")).alias("content"), F.when(i % 3 == 0, F.array(F.lit("bold"), F.lit("none"))).alias("styles"))
    b = table(spark, d, "benchmark").select("item_id", SP.styled(F.to_json(F.transform(w, span))).alias("x"))
    return b.select("item_id", "x.text", F.transform("x.runs", lambda r: F.concat(r.start.cast("string"), F.lit("-"), r.stop.cast("string"))).alias("runs"))


@query("h52_joined_styles", "with p as (select p_partkey k, p_name n, p_size z, length(p_name) l from part) select k, case when z % 3 = 0 then n || ' $x_' || z || '$ is' when z % 3 = 1 then '(' || '$x$' || ' ), ' || n else n || z end as text, case when z % 3 = 0 then ['0-' || l || ':bold,italic', (l + 5 + length(z::varchar) + 1) || '-' || (l + 5 + length(z::varchar) + 3) || ':code'] when z % 3 = 1 then ['8-' || (8 + l) || ':bold'] else ['0-' || l || ':bold', l || '-' || (l + length(z::varchar)) || ':superscript'] end runs from p")
def _(spark, d):
    # a formula between words, one in brackets before a blank one, and a superscript; a link passes its style on
    n, z = F.col("p_name"), F.col("p_size").cast("string")
    q = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    part = lambda kind, content, styles="[]": F.concat(F.lit(f'{{"type": "{kind}", "content": '), content, F.lit(f', "styles": {styles}}}'))
    bold = '["bold", "wavy"]'
    one = [part("hyperlink", F.concat(F.lit("["), part("text", q(n), '["italic"]'), F.lit("]")), bold), part("equation_inline", q(F.concat(F.lit(" x_"), z))), part("code_inline", q(F.lit("is  ")))]
    two = [part("text", q(F.lit("  ("))), part("equation_inline", q(F.lit("x"))), part("equation_inline", q(F.lit("  "))), part("text", q(F.lit("), "))), part("text", q(F.concat(n, F.lit("\t"))), bold)]
    three = [part("text", q(n), bold), part("text", q(z), '["superscript"]')]
    spans = lambda xs: F.concat(F.lit("["), F.concat_ws(", ", *xs), F.lit("]"))
    s = F.when(F.col("p_size") % 3 == 0, spans(one)).when(F.col("p_size") % 3 == 1, spans(two)).otherwise(spans(three))
    x = dealt(table(spark, d, "part").select("p_partkey", "p_name", "p_size")).select(F.col("p_partkey").alias("k"), SP.styled(s).alias("x"))
    return x.select("k", "x.text", F.transform("x.runs", lambda r: F.concat(r.start.cast("string"), F.lit("-"), r.stop.cast("string"), F.lit(":"), F.array_join(r.styles, ","))).alias("runs"))


@query("a06_archives", "select 'n' || p_partkey || '.zip' name, 'a/' || p_partkey || '.json' member, '{\"n\": ' || p_size || '}' as value from part where p_partkey % 5 <> 0")
def _(spark, d):
    # an archive for each part, with members that lead out of it; some files are none
    k = F.col("p_partkey").cast("string")
    names = F.array(F.lit("../a/evil.json"), F.lit("/abs.json"), F.lit("image.png"), F.concat(F.lit("b/"), k, F.lit(".json")), F.concat(F.lit("a/"), k, F.lit(".json")))
    values_ = F.array(F.lit("{}"), F.lit("{}"), F.lit("x"), F.lit("{}"), F.concat(F.lit('{"n": '), F.col("p_size").cast("string"), F.lit("}")))
    z = R.archived(dealt(table(spark, d, "part").select("p_partkey", "p_size")).select(F.concat(F.lit("in/n"), k, F.lit(".zip")).alias("path"), names.alias("names"), values_.alias("values")))
    broken = F.regexp_extract("path", r"n(\d+)", 1).cast("long") % 5 == 0
    return R.archive_members(z.withColumn("content", F.when(broken, F.substring("content", 1, 20)).otherwise(F.col("content")))).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "member", "value")


def _records(spark, d, value, good, schema: str):
    """Texts that stand for stored JSON records, some of them cut short, as read again."""
    path = f"{shared.folder(spark)}/records-{shared.uuid.uuid4().hex}"
    table(spark, d, "part").select(F.when(good, value).otherwise(F.substring(value, F.lit(1), F.length(value) - 2)).alias("value")).write.text(path)
    return R.read_records(spark, path, schema)


@query("a28_stored_analysis", "select p_partkey doc, [p_brand, p_type] terms from part where p_partkey % 4 <> 1")
def _(spark, d):
    v = F.to_json(F.struct(F.col("p_partkey").alias("doc"), F.array("p_brand", "p_type").alias("terms")))
    return _records(spark, d, v, F.col("p_partkey") % 4 != 1, "doc long, terms array<string>")


@query("a31_cached_result", "select p_partkey \"key\", p_name title from part where p_partkey % 3 <> 2 and p_size > 10")
def _(spark, d):
    v = F.to_json(F.struct(F.col("p_partkey").alias("key"), F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("size")).alias("work")))
    return _records(spark, d, v, F.col("p_partkey") % 3 != 2, "key long, work struct<title:string,size:int>").where("work.size > 10").select("key", "work.title")


@query("a30_partial_map", "select conv_id, case when conv_id % 2 = 0 then count(*) else count(*) filter (turn < 2) end n from conversations group by 1")
def _(spark, d):
    # work in progress, then whole for some of the documents
    path = f"{shared.folder(spark)}/partial-{shared.uuid.uuid4().hex}"
    c = table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("translated"), (F.col("conv_id") % 16).alias("part"))
    R.write_keyed(c.where("turn < 2"), path, "part")
    R.write_keyed(c.where("conv_id % 2 = 0"), path, "part")
    return spark.read.parquet(path).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("a21_joined_lines", f"with {LINES}, w as (select doc_id, pos, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w from para) select doc_id, pos, case when len(w) < 2 or not regexp_matches(w[2], '^\\p{{Ll}}') then array_to_string(list_concat([w[1] || '-'], w[2:]), ' ') else w[1] || case when list_contains({literal(T.COMPOUND_PREFIXES)}, lower(w[1])) then '-' else '' end || array_to_string(w[2:], ' ') end as text from w where len(w) > 0")
def _(spark, d):
    # the first word of a line is cut off with a hyphen
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    p = paragraphs(spark, d).withColumn("w", w).where("size(w) > 0")
    return p.select("doc_id", "pos", T.join_wrapped_lines(F.filter(F.array(F.concat(F.col("w")[0], F.lit("-")), F.array_join(F.slice("w", 2, 1_000_000), " ")), lambda x: x != "")).alias("text"))


# calls


@query("j02_streamed_chunks", "select conv_id, turn, i::int seq, substr(text, i * 200 + 1, 200) chunk from conversations, range(0, 100000) r(i) where i * 200 < length(text)")
def _(spark, d):
    spark.udtf.register("stream_reply", P.StreamReply)
    table(spark, d, "conversations").select("conv_id", "turn", "text").createOrReplaceTempView("replies_to_stream")
    return spark.sql("select conv_id, turn, seq, chunk from replies_to_stream, lateral stream_reply(text, 200)")


def first_words(prompt: str) -> str:
    """A stand-in that names a text's first word as its term."""
    w = prompt.split(" ")[0]
    return json.dumps({"terms": [{"source": w, "target": f"{len(prompt)}"}], "summary": prompt[:10]})


@query("j06_analyse", f"with {LINES}, u as (select doc_id doc, page, string_agg(text, ' ' order by pos) t from para group by all), w as (select *, string_split(t, ' ')[1] w from u), m as (select doc, lower(w) k, arg_min(w, page) source, arg_min(length(t)::varchar, page) target, list(page order by page) pages from w where w <> '' group by all) select doc, source, target, pages, n::bigint units from m join (select doc, count(*) n from u group by 1) using (doc)")
def _(spark, d):
    p = paragraphs(spark, d).select(F.col("doc_id").alias("doc"), F.col("page").alias("unit"), "pos", "text")
    return A.analyse(p, first_words).select("doc", "source", "target", F.col("units_of").alias("pages"), "units")


def bracket(text: str) -> str:
    """A stand-in that loses everything when a text starts with a vowel."""
    return "x" if text[:1] in tuple("AEIOU") else f"<{text}>"


@query("j07_guarded_batch", f"with {LINES} select doc_id, pos, case when left(text, 1) in ('A', 'E', 'I', 'O', 'U') then case when regexp_matches(text, '\\$[^$\\n]+\\$') then text else 'x' end else '<' || text || '>' end translated from para")
def _(spark, d):
    return C.guarded(paragraphs(spark, d).select("doc_id", "pos", "text"), bracket).select("doc_id", "pos", "translated")


def relate(prompt: str) -> str:
    """A stand-in that relates each item, and one that wasn't asked."""
    items = json.loads(prompt)["items"]
    return json.dumps({"items": [{"key": x["key"], "relation": f" about {x['key']} "} for x in items if x["key"] % 5] + [{"key": "other", "relation": "no"}, {"key": items[0]["key"], "relation": "y" * 200}]})


@query("j08_chunked_relations", "select item_id::varchar as \"key\", 'about ' || item_id relation from benchmark where item_id % 5 <> 0")
def _(spark, d):
    return C.chunked(table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"), relate)


def erring(prompt: str, allowance: int) -> str:
    """A stand-in that fails in the way that the prompt's first figure says."""
    kind = int(prompt[0])
    if kind in (1, 2, 3):
        raise C.CallError(("rate_limit", "auth", "server")[kind - 1])
    if kind == 4 and allowance < 400:
        raise C.CallError("truncated")
    if kind == 6 or (kind == 5 and "JSON object" not in prompt):
        return "[1]"
    return json.dumps({"kind": kind, "allowance": allowance})


@query("j13_requests", "select doc_id, case doc_id % 7 when 1 then 'rate_limit' when 2 then 'auth' when 3 then 'server' when 6 then 'invalid' else '' end failure, case doc_id % 7 when 1 then 3 when 2 then 1 when 3 then 2 when 4 then 3 when 5 then 2 when 6 then 2 else 1 end::int calls, case doc_id % 7 when 0 then 100 when 4 then 400 when 5 then 100 end::bigint allowance from documents")
def _(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.concat((F.col("doc_id") % 7).cast("string"), F.lit(" prompt")).alias("prompt"))
    r = C.requests(q, erring, 100, 1000, pause=0.0)
    return r.select("doc_id", "outcome.failure", "outcome.calls", F.get_json_object("outcome.value", "$.allowance").cast("long").alias("allowance"))


def lower_start(text: str, reply: str) -> bool:
    return not reply[:1].isupper() or not reply[:1].isascii()


@query("j14_validated_or_source", "with r as (select conv_id, turn, text, array_to_string(list_reverse(string_split(text, ' ')), ' ') r from conversations) select conv_id, turn, case when regexp_matches(left(r, 1), '[A-Z]') then text else r end reply from r")
def _(spark, d):
    return P.call(table(spark, d, "conversations").select("conv_id", "turn", "text"), P.echo, ok=lower_start).select("conv_id", "turn", "reply")


def five_terms(text: str) -> str:
    words = text.split(" ")[:5]
    return json.dumps({"terms": [{"source": w, "target": w if len(w) % 2 else w + "x"} for w in words]})


@query("j15_extracted_terms", "with w as (select item_id doc, unnest(range(0, 5))::int pos, unnest(string_split(text, ' ')[1:5]) w from benchmark), c as (select doc, pos, trim(regexp_replace(w, '\\s+', ' ', 'g')) source, trim(regexp_replace(case when length(w) % 2 = 1 then w else w || 'x' end, '\\s+', ' ', 'g')) target from w where w is not null) select doc, pos, source, target from c where source <> '' and target <> '' and lower(source) <> lower(target) and length(source) <= 80 and length(target) <= 80 qualify row_number() over (partition by doc, lower(source) order by pos) = 1")
def _(spark, d):
    return C.extracted_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text"), five_terms)


def points(prompt: str) -> str:
    if len(prompt) % 3 == 0 and "JSON object only" not in prompt:
        return "sorry"
    return json.dumps({"points": [{"category": "aim", "text": "a"}, {"category": "method" if prompt[:1] < "M" else "aim", "text": "m"}, {"category": "result", "text": " "}]})


@query("j16_synthesis", "select item_id doc, case when left(text, 1) < 'M' then 'READY' else 'PARTIAL' end status, 2 points, length(text) % 3 = 0 repaired from benchmark")
def _(spark, d):
    return C.synthesis(table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text"), points, ["aim", "method"])


def seventh(text: str) -> str:
    if len(text) % 7 == 0:
        raise C.CallError("timeout")
    return text[:40]


@query("i10_call_ledger", f"select 'translate' operation, length(text) % 7 <> 0 ok, case when length(text) % 7 = 0 then 'timeout' end error, count(*) n, sum(case when length(text) % 7 <> 0 then {TOK} end)::bigint input_tokens from conversations group by all")
def _(spark, d):
    calls = C.with_ledger(table(spark, d, "conversations").select("conv_id", "turn", "text"), seventh, "translate")
    return C.ledger_rows(calls).groupBy("operation", "ok", "error").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"))


@query("i10_observed_ledger", f"select 'translate' operation, count(*) calls, count(*) filter (length(text) % 7 = 0) failed, sum(case when length(text) % 7 <> 0 then {TOK} end)::bigint input_tokens from conversations")
def _(spark, d):
    # the totals of a job's calls, counted while its rows are written
    path = f"{shared.folder(spark)}/observed-{shared.uuid.uuid4().hex}"
    calls, totals = C.observed(C.with_ledger(table(spark, d, "conversations").select("conv_id", "turn", "text"), seventh, "translate"), "translate")
    calls.write.parquet(path)
    t = totals()
    return inline(spark, "operation string, calls long, failed long, input_tokens long", [(t["operation"], t["calls"], t["failed"], t["input_tokens"])])


# streams


def _answers(spark, d):
    """Answers of a model in chunks: prose with brackets, then an object with two arrays whose objects hold arrays, then a fence."""
    one = F.to_json(F.struct("turn", "role", F.lit('a "]} b').alias("note"), F.array(F.struct(F.col("turn").alias("inner"))).alias("deep")))
    of = lambda hit: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("turn", "role", one.alias("o"))))), lambda x: x.o), ",\n "), F.lit("]"))
    said = F.col("role") == "assistant"
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit('See [1] {here}:\n```json\n{"headings": '), of(~said), F.lit(', "n": [1, [2]], "paragraphs": '), of(said), F.lit("}\n```")).alias("t"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 37).cast("int")), lambda i: F.substring("t", i * 37 + 1, F.lit(37)))
    return c.select(F.col("conv_id").cast("string").alias("stream_id"), F.posexplode(pieces).alias("seq", "chunk"))


_I01 = "select conv_id stream_id, (row_number() over (partition by conv_id order by role = 'assistant', turn, role) - 1)::int n, turn, role from conversations"


def _found(o):
    v = F.from_json("value", "turn long, role string")
    return o.select(F.col("stream_id").cast("long").alias("stream_id"), "n", v["turn"].alias("turn"), v["role"].alias("role"))


@query("i01_objects_of_chunks", _I01)
def _(spark, d):
    return _found(jobs.objects_batch(_answers(spark, d)))


@query("i01_objects_streamed", _I01)
def _(spark, d):
    # two files: the later chunks come first, some of them twice
    path = f"{shared.folder(spark)}/chunks-{shared.uuid.uuid4().hex}"
    c = _answers(spark, d)
    c.where("seq > 3").write.parquet(f"{path}/in/a")
    c.where("seq < 6").write.parquet(f"{path}/in/b")
    src = spark.readStream.schema(c.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    with jobs.typed_state(spark):
        jobs.landed(jobs.objects(src), f"{path}/out", f"{path}/state", once=True).awaitTermination()
    return _found(spark.read.parquet(f"{path}/out"))


_TERM = "regexp_matches(text, '(?i)(^|[^A-Za-z0-9]){}(e?s)?($|[^A-Za-z0-9])')"


@query("i02_late_terms", f"with t as (select conv_id * 1000 + turn id, text, {_TERM.format('the')} and not contains(lower(text), 'das') a, {_TERM.format('is')} and not contains(lower(text), 'ist') b from conversations) select id, 0 as version from t union all select id, 1 from t where a union all select id, 2 from t where b")
def _(spark, d):
    # all rows are done before any term is known; then two versions of a glossary come, each of them twice
    path = f"{shared.folder(spark)}/late-{shared.uuid.uuid4().hex}"
    texts = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text").where("id is not null").dropDuplicates(["id"])
    texts.select("id", F.col("text").alias("done"), F.lit(0).alias("version")).write.parquet(path)
    run = jobs.late_terms(spark, texts, path, lambda rows, v: rows.select("id", F.concat(F.lit(f"v{v} "), "text").alias("done")))
    for epoch, term in enumerate([("the", "das", 1), ("the", "das", 1), ("is", "ist", 2), ("is", "ist", 2)]):
        run(inline(spark, "source string, target string, version int", [term]), epoch)
    return spark.read.parquet(path).select("id", "version")


@query("i02_resumed_job", "select conv_id * 1000 + turn id, case when turn % 3 = 0 then 'before' else upper(role) end done from conversations")
def _(spark, d):
    path = f"{shared.folder(spark)}/job-{shared.uuid.uuid4().hex}"
    planned = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "role")
    planned.where("turn % 3 = 0").select("id", F.lit("before").alias("done")).write.parquet(path)
    run = jobs.resumable(spark, planned, path, lambda todo: todo.select("id", F.upper("role").alias("done")))
    run(planned.unionByName(planned.limit(5)), 0)
    run(planned, 1)
    return spark.read.parquet(path)


@query("i11_progressive_commit", "select event_id, value from events where event_type <> 'error'")
def _(spark, d):
    path = f"{shared.folder(spark)}/landed-{shared.uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).where("event_type <> 'error'").select("event_id", "value")
    jobs.landed(rows, path, f"{path}-state", once=True).awaitTermination()
    return spark.read.parquet(path)


# works


@query("c28_identify_work", "with w as (select p_partkey, p_name || ' number ' || p_partkey title, case when p_partkey % 2 = 0 then '10.1/' || p_partkey end doi from part), q as (select p_partkey qid, case p_partkey % 3 when 0 then upper(title) || '!' when 1 then title else 'nothing of this kind ever' end title, case when p_partkey % 4 = 0 then '10.1/' || (p_partkey + 2) end doi from w) select qid, coalesce(d.p_partkey, t.p_partkey) work from q left join w d on q.doi = d.doi left join w t on d.p_partkey is null and trim(regexp_replace(lower(q.title), '[^a-z0-9]+', ' ', 'g')) = t.title where coalesce(d.p_partkey, t.p_partkey) is not null")
def _(spark, d):
    k = F.col("p_partkey")
    w = table(spark, d, "part").select(k.alias("work"), F.concat("p_name", F.lit(" number "), k.cast("string")).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"))
    title = F.when(F.col("work") % 3 == 0, F.concat(F.upper("title"), F.lit("!"))).when(F.col("work") % 3 == 1, F.col("title")).otherwise("nothing of this kind ever")
    q = w.select(F.col("work").alias("qid"), title.alias("title"), F.when(F.col("work") % 4 == 0, F.concat(F.lit("10.1/"), (F.col("work") + 2).cast("string"))).alias("doi"))
    return L.identify(q, w)

