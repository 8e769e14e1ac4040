"""Structure, identity and budget queries (groups C, D, E and part of F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budgets as B
from ..operators import structure as S
from ..operators.shared import placed
from .base import LINES, paragraphs, query, table, values
from .scalars import CONT

#: Lines as blocks: every tenth by a hash of place and length is a title, every eleventh a figure; size and box follow from length and place.
LAY = "case when (pos * 7 + length(text)) % 10 = 0 then 'title' when (pos * 5 + length(text)) % 11 = 0 then 'figure' else 'plain text' end"
BLOCKS = f"{LINES}, bl as (select doc_id doc, pos, page, {LAY} layout, text, (8 + length(text) % 5)::double size from para)"


def _blocks(spark, d):
    p = paragraphs(spark, d)
    lay = F.expr("case when (pos * 7 + length(text)) % 10 = 0 then 'title' when (pos * 5 + length(text)) % 11 = 0 then 'figure' else 'plain text' end")
    return p.select(F.col("doc_id").alias("doc"), "pos", "page", lay.alias("layout"), "text", (8 + F.length("text") % 5).cast("double").alias("size"))


ISL = f"""kept as (select * from bl where layout <> 'plain text' or (length(trim(text)) >= 2 and regexp_matches(text, '\\p{{L}}'))),
lg as (select *, lag(case when layout = 'plain text' then text end) over (partition by doc order by pos) p from kept),
isl as (select *, sum(case when layout = 'plain text' and coalesce({CONT}, false) then 0 else 1 end) over (partition by doc order by pos) g from lg)"""


@query("e01_assemble_paragraphs", f"with {BLOCKS}, {ISL} select doc, min(pos) start, min(page) page, max(page) end_page, count(*) n, string_agg(trim(regexp_replace(text, '[\\t ]+', ' ', 'g')), ' ' order by pos) as text from isl where layout = 'plain text' group by doc, g")
def _(spark, d):
    return S.assemble_paragraphs(_blocks(spark, d)).select("doc", "start", "page", "end_page", "n", "text")


@query("b14_anchorable_blocks", f"with {BLOCKS} select doc, pos from bl where layout in ('figure', 'title') and trim(text) <> ''")
def _(spark, d):
    return _blocks(spark, d).where(F.col("layout").isin("figure", "title") & (F.trim("text") != "")).select("doc", "pos")


@query("c02_section_as_of", f"with {BLOCKS}, h as (select * from bl where layout = 'title') select b.doc, b.pos, h.pos::varchar section from bl b asof left join h on b.doc = h.doc and b.pos > h.pos where b.layout = 'plain text'")
def _(spark, d):
    b = _blocks(spark, d)
    return S.assign_sections(b.where("layout = 'plain text'"), b.where("layout = 'title'").select("doc", "pos", F.col("pos").cast("string").alias("section")))


@query("d01_body_size", f"with {BLOCKS}, s as (select doc, page, size, sum(length(text)) w, min(pos) f from bl where layout = 'plain text' group by all) select doc, page, arg_max(size, w * 1000000 - f) body from s group by all")
def _(spark, d):
    return S.body_size(_blocks(spark, d).where("layout = 'plain text'"))


@query("b05_heading_sized", f"with {BLOCKS}, s as (select doc, page, size, sum(length(text)) w, min(pos) f from bl where layout = 'plain text' group by all), m as (select doc, page, arg_max(size, w * 1000000 - f) body from s group by all) select bl.doc, bl.pos, coalesce(size > body + 0.4, true) heading from bl left join m using (doc, page) where layout = 'title'")
def _(spark, d):
    b = _blocks(spark, d)
    m = S.body_size(b.where("layout = 'plain text'"))
    return b.where("layout = 'title'").join(m, ["doc", "page"], "left").select("doc", "pos", S.is_heading_sized(F.col("size"), F.col("body")).alias("heading"))


@query("e02_page_ordinals", f"with {BLOCKS} select doc, pos, (row_number() over (partition by doc, page order by pos) - 1)::int ord from bl")
def _(spark, d):
    return _blocks(spark, d).select("doc", "pos", (F.row_number().over(Window.partitionBy("doc", "page").orderBy("pos")) - 1).alias("ord"))


@query("e03_section_ends", f"with {BLOCKS}, h as (select *, max(page) over (partition by doc) pc from bl) select doc, pos, page, greatest(page, coalesce(lead(page) over (partition by doc order by pos) - 1, pc)) last_page from h where layout = 'title'")
def _(spark, d):
    b = _blocks(spark, d).withColumn("page_count", F.max("page").over(Window.partitionBy("doc")))
    return S.section_ends(b.where("layout = 'title'")).select("doc", "pos", "page", "last_page")


HEADS = [(0, "a", "1 Intro"), (1, "b", "1.1 Data"), (2, "c", "2 Method"), (3, "d", "2.1 Net"), (4, "e", "3 Results"), (5, "f", "2.2 Late"), (6, "g", "Unnumbered"), (7, "h", "3.1.1 Deep"), (8, "i", "C.1 Orphan"), (9, "j", "2.1.1 Deep two")]
PARENTS = [("a", None), ("b", "a"), ("c", None), ("d", "c"), ("e", None), ("f", "c"), ("g", None), ("h", "g"), ("i", "g"), ("j", "d")]


@query("e04_hierarchy", f"with {values('p', 'section, parent', PARENTS)} select p_partkey doc, section, parent from part, p")
def _(spark, d):
    # a paper for each part, whose name ends all titles
    heads = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("section"), F.lit(t).alias("t")) for i, k, t in HEADS])
    h = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), "p_name", F.explode(heads).alias("h")).select("doc", "h.pos", F.concat_ws("|", "doc", "h.section").alias("section"), F.concat_ws(" ", "h.t", "p_name").alias("title"))
    last = lambda c: F.regexp_extract(c, r"([^|]+)$", 1)
    return S.hierarchy(h).select(F.regexp_extract("section", r"^(\d+)", 1).cast("long").alias("doc"), last("section").alias("section"), F.when(F.col("parent").isNotNull(), last("parent")).alias("parent"))


#: Parts as a tree: half of a part's number is its parent, and one in ten has a parent that isn't there.
TREE = "t as (select p_partkey section, case when p_partkey % 10 = 9 then -p_partkey when p_partkey > 1 then p_partkey // 2 end parent, p_size ord from part)"


def _tree(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("section"), F.when(k % 10 == 9, -k).when(k > 1, F.expr("p_partkey div 2")).alias("parent"), F.col("p_size").alias("ord"))


@query("f14_outline_tree", f"with recursive {TREE}, s as (select section, case when parent in (select section from t) then parent end parent, ord from t), r as (select section, 0 depth, [ord] path from s where parent is null union all select s.section, depth + 1, list_append(path, s.ord) from s join r on s.parent = r.section) select * from r")
def _(spark, d):
    return S.outline(_tree(spark, d))


@query("f15_ancestors", f"with recursive {TREE}, r as (select section, parent anc, 1 k from t where parent is not null union all select r.section, t.parent, k + 1 from r join t on r.anc = t.section where t.parent is not null) select section, anc, k from r")
def _(spark, d):
    return S.ancestors(_tree(spark, d))


@query("f13_number_order", "with n as (select distinct case l_linenumber % 4 when 0 then l_linenumber || '.' || (l_partkey % 30) when 1 then l_linenumber || '.' || (l_partkey % 12) || '.' || (l_suppkey % 11) when 2 then chr((65 + l_partkey % 5)::int) || '.' || (l_suppkey % 20) else (l_partkey % 25)::varchar end num from lineitem), p as (select num, list_transform(string_split(num, '.'), lambda p: case when regexp_matches(p, '^[0-9]+$') then '0' || lpad(p, 9, '0') else '1' || p end) k from n) select num, row_number() over (order by k)::bigint place from p")
def _(spark, d):
    n, p, u = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *xs: F.concat(*[x if isinstance(x, str) is False else F.lit(x) for x in xs])
    part = lambda x: x.cast("string")
    num = F.when(n % 4 == 0, text(part(n), ".", part(p % 30))).when(n % 4 == 1, text(part(n), ".", part(p % 12), ".", part(u % 11))).when(n % 4 == 2, text(F.char((65 + p % 5).cast("int")), ".", part(u % 20))).otherwise(part(p % 25))
    rows = table(spark, d, "lineitem").select(num.alias("num")).distinct()
    return placed(rows.withColumn("k", S.number_key(F.col("num"))), [F.col("k")]).select("num", F.col("place").cast("long").alias("place"))


@query("f16_first_reading_target", "select p_brand, arg_min(p_name, p_partkey) target from part where p_size % 3 = 1 and not p_name like 'red%' group by 1")
def _(spark, d):
    return table(spark, d, "part").where("p_size % 3 = 1 and not p_name like 'red%'").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("target"))


@query("f08_title_block", f"with {BLOCKS} select doc, arg_max(pos, size * 1000000 + (length(text) % 7) * 1000 - pos) pos from bl where page = 1 and layout = 'title' and trim(text) <> '' group by 1")
def _(spark, d):
    return S.title_block(_blocks(spark, d).withColumn("y0", F.lit(0.0)).withColumn("y1", (F.length("text") % 7).cast("double")))


@query("c03_captions", f"with {BLOCKS}, g as (select *, pos * 20.0 y0, pos * 20.0 + 12 + length(text) % 5 y1 from bl), c as (select * from g where layout = 'title'), e as (select * from g where layout = 'figure') select c.doc, c.page, c.pos, arg_min(e.pos, abs(e.y0 - c.y1) * 1000000 + e.pos) caption_of from c join e using (doc, page) group by all")
def _(spark, d):
    g = _blocks(spark, d).withColumn("y0", F.col("pos") * 20.0).withColumn("y1", F.col("pos") * 20.0 + 12 + F.length("text") % 5)
    return S.link_captions(g, {"title": ["figure"]})


@query("c04_lines_in_boxes", f"with {BLOCKS} select b.doc, b.page, b.pos as line, min(x.pos) box from bl b left join bl x on b.doc = x.doc and b.page = x.page and x.layout = 'figure' and b.pos between x.pos - 1 and x.pos + 1 group by all")
def _(spark, d):
    b = _blocks(spark, d)
    lines = b.select("doc", "page", F.col("pos").alias("line"), F.lit(1.0).alias("cx"), F.col("pos").cast("double").alias("cy"))
    boxes = b.where("layout = 'figure'").select("doc", "page", F.col("pos").alias("box"), F.lit(0.0).alias("x0"), F.lit(2.0).alias("x1"), (F.col("pos") - 1.0).alias("y0"), (F.col("pos") + 1.0).alias("y1"))
    return S.first_line_boxes(lines, boxes)


@query("f05_reading_order", f"with {BLOCKS} select doc, page, pos, row_number() over (partition by doc, page order by case when n >= 4 then pos % 2 else 0 end, pos // 2, pos % 2)::int rank from (select *, count(*) over (partition by doc, page) n from bl)")
def _(spark, d):
    b = _blocks(spark, d).withColumn("x0", F.when(F.col("pos") % 2 == 0, 0.0).otherwise(320.0)).withColumn("x1", F.col("x0") + 280).withColumn("y0", F.expr("pos div 2") * 20.0)
    return S.reading_order(b)


@query("c07_reattach", f"with {LINES}, t as (select doc_id, pos, page, substr(text, 3, 30) q, case when pos % 3 = 0 then sha256(doc_id || '_' || pos) else 'gone' end anchor from para), n as (select t.doc_id, t.pos, t.anchor, trim(regexp_replace(q, '[\\t ]+', ' ', 'g')) needle, t.page from t), c as (select n.doc_id, n.pos, count(p.pos) filter (contains(trim(regexp_replace(p.text, '[\\t ]+', ' ', 'g')), needle) and needle <> '') h, count(p.pos) filter (needle <> '' and trim(p.text) <> '' and contains(needle, trim(regexp_replace(p.text, '[\\t ]+', ' ', 'g')))) w from n left join para p on p.doc_id = n.doc_id and p.page = n.page group by all) select doc_id, pos, case when pos % 3 = 0 then 'EXACT' when h = 1 then 'REATTACHED' when h > 1 then 'AMBIGUOUS' when w = 1 then 'REATTACHED' when w > 1 then 'AMBIGUOUS' else 'ORPHANED' end state from c")
def _(spark, d):
    p = paragraphs(spark, d).withColumn("id", F.concat_ws("_", "doc_id", "pos")).withColumn("anchor", F.sha2("id", 256))
    t = p.select(F.col("id").alias("target"), F.when(F.col("pos") % 3 == 0, F.col("anchor")).otherwise("gone").alias("anchor"), F.col("doc_id").alias("doc"), "page", F.substring("text", 3, 30).alias("quote"))
    r = S.reattach(t, p.select("id", "anchor", F.col("doc_id").alias("doc"), "page", "text"))
    return r.select(F.split("target", "_")[0].cast("long").alias("doc_id"), F.split("target", "_")[1].cast("int").alias("pos"), "state")


@query("c12_section_of_page", f"with {BLOCKS}, h as (select *, greatest(page, coalesce(lead(page) over (partition by doc order by pos) - 1, 99)) last_page from bl where layout = 'title') select b.doc, b.pos, arg_max(h.pos, h.pos) section from bl b left join h on b.doc = h.doc and b.page between h.page and h.last_page group by all")
def _(spark, d):
    b = _blocks(spark, d)
    h = S.section_ends(b.where("layout = 'title'").withColumn("page_count", F.lit(99))).select("doc", F.col("pos").alias("section"), F.col("page").alias("lo"), F.col("last_page").alias("hi"))
    x = b.alias("b").join(h.alias("h"), F.expr("b.doc = h.doc and b.page between h.lo and h.hi"), "left")
    return x.groupBy("b.doc", "b.pos").agg(F.max("h.section").alias("section"))


@query("c21_block_sections", "select conv_id, turn, min(role) first_role from conversations group by all")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("first_role"))


@query("c22_heading_anchor", f"with {BLOCKS} select doc, coalesce(min(pos) filter (layout = 'title'), min(pos) filter (layout = 'plain text'), 0) anchor from bl group by 1")
def _(spark, d):
    b = _blocks(spark, d)
    return b.groupBy("doc").agg(F.coalesce(F.min(F.when(F.col("layout") == "title", F.col("pos"))), F.min(F.when(F.col("layout") == "plain text", F.col("pos"))), F.lit(0)).alias("anchor"))


@query("b07_front_matter_rows", f"with {LINES}, a as (select doc_id, min(pos) f, list(distinct page) pg from para where contains(lower(text), 'the') group by 1) select p.doc_id, p.pos, coalesce(list_contains(pg, page) and pos < f, false) front from para p left join a using (doc_id)")
def _(spark, d):
    p = paragraphs(spark, d).withColumn("abs", F.contains(F.lower("text"), F.lit("the")))
    w = Window.partitionBy("doc_id")
    p = p.withColumn("f", F.min(F.when(F.col("abs"), F.col("pos"))).over(w)).withColumn("pg", F.collect_set(F.when(F.col("abs"), F.col("page"))).over(w))
    return p.select("doc_id", "pos", F.coalesce(F.array_contains("pg", F.col("page")) & (F.col("pos") < F.col("f")), F.lit(False)).alias("front"))


@query("d03_box_union", "select l_orderkey, min(l_quantity) x0, min(l_tax) y0, max(l_extendedprice) x1, max(l_discount) y1 from lineitem group by 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.min("l_tax").alias("y0"), F.max("l_extendedprice").alias("x1"), F.max("l_discount").alias("y1"))


@query("d04_nested_envelope", "select l_orderkey, min(l_quantity) lo, max(l_quantity) hi from lineitem group by 1")
def _(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return b.select("l_orderkey", F.array_min("q").alias("lo"), F.array_max("q").alias("hi"))


@query("e05_neighbour_texts", f"with {LINES} select doc_id, pos, nullif(trim(lag(text) over w), '') before, nullif(trim(lead(text) over w), '') after from para window w as (partition by doc_id order by pos)")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return paragraphs(spark, d).select("doc_id", "pos", F.nullif(F.trim(F.lag("text").over(w)), F.lit("")).alias("before"), F.nullif(F.trim(F.lead("text").over(w)), F.lit("")).alias("after"))


@query("e06_character_window", f"with {LINES}, s as (select doc_id, pos, coalesce(sum(length(text) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) st from para) select doc_id, pos, min(pos) over w lo, max(pos) over w hi from s window w as (partition by doc_id order by st range between 800 preceding and 800 following)")
def _(spark, d):
    return B.char_window(paragraphs(spark, d).select("doc_id", "pos", F.length("text").alias("chars")), key="doc_id")


FOLD = """{first} union all select p.doc_id, p.pos, {new}, {n}, {size} from f join c p on p.doc_id = f.doc_id and p.pos = f.pos + 1"""
FULL = "(f.n >= case when f.batch = 1 then 3 else 15 end or f.size + p.chars > case when f.batch = 1 then 1500 else 5000 end)"


@query("e07_greedy_batches", f"with recursive {LINES}, c as (select doc_id, pos, length(text) chars from para), f(doc_id, pos, batch, n, size) as ({FOLD.format(first='select doc_id, pos, 1, 1, chars from c where pos = 0', new=f'f.batch + {FULL}::int', n=f'case when {FULL} then 1 else f.n + 1 end', size=f'case when {FULL} then p.chars else f.size + p.chars end')}) select doc_id, pos, batch from f")
def _(spark, d):
    return B.greedy_batches(paragraphs(spark, d).select("doc_id", "pos", F.length("text").alias("chars")), key="doc_id")


TK = "ceil(length(text) / 3.5)::bigint"
FULL8 = "(f.size + p.tokens > 900)"


@query("e08_token_chunks", f"with recursive {LINES}, c as (select doc_id, pos, {TK} tokens from para), f(doc_id, pos, batch, n, size) as ({FOLD.format(first='select doc_id, pos, 1, 1, 500 + tokens from c where pos = 0', new=f'f.batch + {FULL8}::int', n='1', size=f'case when {FULL8} then p.tokens else f.size + p.tokens end')}) select doc_id, pos, batch from f")
def _(spark, d):
    return B.token_chunks(paragraphs(spark, d).select("doc_id", "pos", F.ceil(F.length("text") / 3.5).alias("tokens")), 900, key="doc_id")


FULL9 = "(f.size + p.tokens > 1200 or (p.pos % 4 = 0 and f.size + p.tokens > 600))"


@query("e09_page_partitions", f"with recursive {LINES}, c as (select doc_id, pos, {TK} tokens from para), f(doc_id, pos, batch, n, size) as ({FOLD.format(first='select doc_id, pos, 1, 1, tokens from c where pos = 0', new=f'f.batch + {FULL9}::int', n='1', size=f'case when {FULL9} then p.tokens else f.size + p.tokens end')}) select doc_id, pos, batch from f")
def _(spark, d):
    return B.page_partitions(paragraphs(spark, d).select("doc_id", "pos", "page", F.ceil(F.length("text") / 3.5).alias("tokens")), key="doc_id")


@query("e10_skip_budget", f"with recursive {LINES}, c as (select doc_id, pos, pos % 2 sec, length(text) chars from para), f(doc_id, pos, total, s0, s1, took) as (select doc_id, pos, case when chars <= 1000 then chars else 0 end, case when chars <= 1000 then chars else 0 end, 0, chars <= 1000 from c where pos = 0 union all select p.doc_id, p.pos, case when ok then f.total + chars else f.total end, case when ok and sec = 0 then s0 + chars else s0 end, case when ok and sec = 1 then s1 + chars else s1 end, ok from (select f.*, p.*, case when p.sec = 0 then f.s0 else f.s1 end + p.chars <= 1000 and f.total + p.chars <= 3000 ok from f join c p on p.doc_id = f.doc_id and p.pos = f.pos + 1) x(doc_id0, pos0, total, s0, s1, took, doc_id, pos, sec, chars, ok), (select 1) p0, lateral (select x.total total) f, lateral (select x.doc_id doc_id, x.pos pos) p) select doc_id, pos from f where took")
def _(spark, d):
    p = paragraphs(spark, d).select("doc_id", "pos", (F.col("pos") % 2).cast("string").alias("section"), F.length("text").alias("chars"))
    return B.skip_budget(p, 3000, 0.3, key="doc_id")


@query("e11_prefix_budget", f"with {LINES}, c as (select doc_id, pos, ceil(sum(length(text) + 10) over (partition by doc_id order by pos) / 3.5) cost from para) select doc_id, pos from c where cost <= 700")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return B.prefix_budget(paragraphs(spark, d), F.ceil(F.sum(F.length("text") + 10).over(w) / 3.5), 700, key="doc_id").select("doc_id", "pos")


@query("e13_reading_position", f"with {LINES}, c as (select doc_id, pos, sum(length(text)) over (partition by doc_id order by pos) h from para) select doc_id, coalesce(min(pos) filter (h >= 500), max(pos)) pos from c group by 1")
def _(spark, d):
    c = paragraphs(spark, d).withColumn("h", F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("pos")))
    return c.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("h") >= 500, F.col("pos"))), F.max("pos")).alias("pos"))


@query("e15_fixed_batches", f"with {LINES} select doc_id, pos, ((row_number() over (partition by doc_id order by pos) - 1) // 15)::int batch from para")
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return paragraphs(spark, d).select("doc_id", "pos", F.floor((r - 1) / 15).cast("int").alias("batch"))


@query("e16_source_text", f"with {LINES}, c as (select *, sum(length(text) + 1) over (partition by doc_id order by pos) s from para) select doc_id, string_agg(text, chr(10) order by pos) as text from c where s <= 2000 group by 1")
def _(spark, d):
    c = paragraphs(spark, d).withColumn("s", F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("pos"))).where("s <= 2000")
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), "\n").alias("text"))


@query("d09_first_occurrence", f"with {LINES} select w, min(doc_id * 100000 + pos) first_at from (select doc_id, pos, unnest(regexp_extract_all(text, '[0-9]+')) w from para) group by 1")
def _(spark, d):
    return paragraphs(spark, d).select("doc_id", "pos", F.explode(T.all_of(F.col("text"), "[0-9]+")).alias("w")).groupBy("w").agg(F.min(F.col("doc_id") * 100000 + F.col("pos")).alias("first_at"))


@query("d19_group_by_section", "select source, list(doc_id order by doc_id) ids from documents group by 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))


@query("d22_character_volume", "select lang, sum(length(text))::bigint chars from documents group by 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
