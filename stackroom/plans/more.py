"""Further rows of the inventory: views, validations, selections, ledgers, maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import commits, shared
from ..operators import selection as SEL
from ..operators import store as S
from ..operators import structure as ST
from ..operators.shared import placed
from .base import LINES, case_table, inline, literal, paragraphs, query, table
from .structure import BLOCKS, _blocks


@query("b08_stationery", f"with {LINES}, a as (select doc_id, min(pos) f, list(distinct page) pg from para where contains(lower(text), 'the') group by 1) select p.doc_id, p.pos, coalesce(list_contains(pg, page) and pos < f and not contains(lower(text), 'the'), false) stationery from para p left join a using (doc_id)")
def _(spark, d):
    p = paragraphs(spark, d).withColumn("abs", F.contains(F.lower("text"), F.lit("the")))
    w = Window.partitionBy("doc_id")
    p = p.withColumn("f", F.min(F.when(F.col("abs"), F.col("pos"))).over(w)).withColumn("pg", F.collect_set(F.when(F.col("abs"), F.col("page"))).over(w))
    return p.select("doc_id", "pos", F.coalesce(~F.col("abs") & F.array_contains("pg", F.col("page")) & (F.col("pos") < F.col("f")), F.lit(False)).alias("stationery"))


@query("b10_runs_on", f"with {LINES} select doc_id, pos, coalesce(page = pp + 1 and length(p) >= 80 and not regexp_matches(p, '[.!?。！？:;…]\\s*$'), false) runs_on from (select *, lag(text) over w p, lag(page) over w pp from para window w as (partition by doc_id order by pos))")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    p = paragraphs(spark, d).withColumn("p", F.lag("text").over(w)).withColumn("pp", F.lag("page").over(w))
    return p.select("doc_id", "pos", F.coalesce((F.col("page") == F.col("pp") + 1) & (F.length("p") >= 80) & ~T.ends_sentence(F.col("p")), F.lit(False)).alias("runs_on"))


@query("b11_reusable", "select doc_id, source = 'src2' and lang in ('en', 'de') reusable from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ((F.col("source") == "src2") & F.col("lang").isin("en", "de")).alias("reusable"))


@query("b15_displayable_blocks", f"with {BLOCKS} select doc, pos, layout from bl where layout = 'figure' or (layout = 'title' and length(text) > 40)")
def _(spark, d):
    return _blocks(spark, d).where((F.col("layout") == "figure") | ((F.col("layout") == "title") & (F.length("text") > 40))).select("doc", "pos", "layout")


@query("b20_figure_labels", f"with {BLOCKS}, g as (select *, pos * 11.0 y0, pos * 11.0 + 10 + length(text) % 9 y1 from bl), t as (select * from g where layout <> 'figure' and length(text) <= 40 and not regexp_matches(text, '[.!?。！？]')), f as (select * from g where layout = 'figure') select distinct t.doc, t.pos from t join f on t.doc = f.doc and t.page = f.page and greatest(0, least(t.y1, f.y1 + 6) - greatest(t.y0, f.y0 - 6)) * 100 >= 0.5 * (t.y1 - t.y0) * 100")
def _(spark, d):
    g = _blocks(spark, d).select("doc", "page", "pos", "layout", "text", F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), (F.col("pos") * 11.0).alias("y0"), (F.col("pos") * 11.0 + 10 + F.length("text") % 9).alias("y1"))
    figures = g.where("layout = 'figure'").withColumns({"y0": F.col("y0") - 6, "y1": F.col("y1") + 6})
    return SEL.figure_labels(g.where("layout <> 'figure'"), figures).select("doc", "pos")


@query("b24_artifact_identity", "select source, lang, count(*) n from documents where n_chars > 50 group by all having count(*) > 3")
def _(spark, d):
    return table(spark, d, "documents").where("n_chars > 50").groupBy("source", "lang").agg(F.count("*").alias("n")).where("n > 3")


@query("b29_outline", f"with {BLOCKS} select doc, pos, trim(text) title, page from bl where layout = 'title' and trim(text) <> ''")
def _(spark, d):
    return _blocks(spark, d).where("layout = 'title' and trim(text) <> ''").select("doc", "pos", F.trim("text").alias("title"), "page")


@query("b30_heading_views", f"with {BLOCKS} select doc, list(pos order by pos) headings from bl where layout = 'title' group by 1")
def _(spark, d):
    return _blocks(spark, d).where("layout = 'title'").groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("headings"))


@query("c08_reattach_blocks", "select p_partkey target, case p_partkey % 4 when 0 then 'EXACT' when 1 then 'REATTACHED' else 'ORPHANED' end state from part")
def _(spark, d):
    # every part is a block; a quarter of the targets have its anchor, the others a quote on the same or another class, or none
    k = F.col("p_partkey")
    layout = lambda x: F.when(x % 2 == 0, "title").otherwise("figure")
    text = F.concat(F.lit("#"), k.cast("string"), F.lit(". "), "p_name")
    b = table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("h"), k.cast("string")).alias("anchor"), F.concat_ws("|", "p_size", layout(k)).alias("doc"), F.lit(1).alias("page"), text.alias("text"))
    t = table(spark, d, "part").select(k.alias("target"), F.when(k % 4 == 0, F.concat(F.lit("h"), k.cast("string"))).otherwise("no").alias("anchor"), F.lit(1).alias("page"), F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("#"), k.cast("string"), F.lit(". "))).alias("quote"), F.concat_ws("|", "p_size", layout(F.when(k % 4 == 2, k + 1).otherwise(k))).alias("doc"))
    return ST.reattach(t, b).select("target", "state")


@query("c15_selected_paragraphs", "select p_partkey doc, 'p1' id from part where p_partkey % 3 > 0 union all select p_partkey, 'p5' from part where p_partkey % 3 = 2")
def _(spark, d):
    # a paper for each part: a selection, and paragraphs under it, beside it, below it, on another page
    p = table(spark, d, "part").withColumn("doc", F.col("p_partkey"))
    words = F.lit("the chosen words")
    box = lambda i, page, x0, y0, x1, y1, text: F.struct(F.lit(i).alias("id"), F.lit(page).alias("page"), *[F.lit(float(v)).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))], text.alias("text"))
    own = F.when(F.col("doc") % 3 == 0, F.col("p_name")).otherwise(F.concat(words, F.lit(" are here, "), "p_name"))
    every = F.array(box("p1", 1, 0, 8, 60, 24, own), box("p2", 1, 48, 8, 90, 24, words), box("p3", 1, 0, 19.5, 60, 40, words), box("p4", 2, 0, 8, 60, 24, words), box("p5", 1, 10, 9, 50, 22, F.when(F.col("doc") % 3 == 2, F.concat(F.lit("again "), words)).otherwise("beside")))
    sel = p.select("doc", F.lit(1).alias("page"), *[F.lit(v).alias(n) for n, v in (("x0", 0.0), ("y0", 10.0), ("x1", 50.0), ("y1", 20.0))])
    return SEL.selected_blocks(sel, p.select("doc", F.explode(every).alias("b")).select("doc", "b.*"), words)


@query("c18_nearest_paragraph", f"with {BLOCKS}, f as (select * from bl where layout = 'figure'), p as (select * from bl where layout = 'plain text') select f.doc, f.pos, arg_min(p.pos, abs(p.page - f.page) * 1000000.0 + abs(p.pos - f.pos) * 1000 + p.pos / 10.0) nearest from f join p using (doc) group by all")
def _(spark, d):
    b = _blocks(spark, d)
    return ST.nearest_in_order(b.where("layout = 'figure'"), b.where("layout = 'plain text'"))


@query("d02_dominant_size", "select l_orderkey, arg_max(l_quantity, w * 1000 - l_quantity) size from (select l_orderkey, l_quantity, count(*) w from lineitem group by all) group by 1")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("w"))
    return g.groupBy("l_orderkey").agg(F.max_by("l_quantity", F.struct("w", (-F.col("l_quantity")).alias("q"))).alias("size"))


@query("d15_outcomes", "select source, count(quality) filter (quality = 1) ok, count(quality) filter (quality = 0) failed from documents left join labels using (doc_id) group by 1")
def _(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") == 0).alias("failed"))


@query("e12_load_shedding", "select l_orderkey doc, l_linenumber part, l_quantity cost from lineitem qualify sum(l_quantity) over (partition by l_orderkey order by l_linenumber desc) <= 60")
def _(spark, d):
    # the lines of an order are the parts of a request; the first ones are shed until the rest fits
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("part"), F.col("l_quantity").alias("cost"))
    return s.withColumn("rest", F.sum("cost").over(Window.partitionBy("doc").orderBy(F.desc("part")))).where("rest <= 60").drop("rest")


def _boxes(spark, d):
    """Boxes of detections: the lines of four orders are a page, in steps of 0.4 points, so that some lie within half a point of others."""
    k, q, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    x0, y0 = (q % 4) * 0.4, (F.col("l_suppkey") % 3) * 0.4
    return table(spark, d, "lineitem").select(F.expr("l_orderkey div 4").alias("page"), (k * 10 + n).alias("id"), (F.col("l_quantity") % 10).alias("score"), x0.alias("x0"), y0.alias("y0"), (x0 + 10 + (n % 2) * 0.4).alias("x1"), (y0 + 5).alias("y1"))


@query(
    "f17_drop_duplicate_boxes",
    "with recursive b as (select l_orderkey // 4 page, l_orderkey * 10 + l_linenumber id, l_quantity % 10 score, (l_partkey % 4) * 0.4::double x0, (l_suppkey % 3) * 0.4::double y0, (l_partkey % 4) * 0.4::double + 10 + (l_linenumber % 2) * 0.4::double x1, (l_suppkey % 3) * 0.4::double + 5 y1 from lineitem), o as (select *, row_number() over (partition by page order by score desc, id, x0, y0, x1, y1) r from b), w as (select page, r, [{id: id, x0: x0, y0: y0, x1: x1, y1: y1}] kept from o where r = 1 union all select o.page, o.r, case when len(list_filter(w.kept, lambda k: abs(k.x0 - o.x0) <= 0.5 and abs(k.y0 - o.y0) <= 0.5 and abs(k.x1 - o.x1) <= 0.5 and abs(k.y1 - o.y1) <= 0.5)) = 0 then list_append(w.kept, {id: o.id, x0: o.x0, y0: o.y0, x1: o.x1, y1: o.y1}) else w.kept end from w join o on o.page = w.page and o.r = w.r + 1) select page, unnest(list_transform(arg_max(kept, r), lambda k: k.id)) id from w group by page",
)
def _(spark, d):
    return SEL.drop_duplicates(_boxes(spark, d)).select("page", "id")


@query("f20_vectors_to_build", "select doc_id from documents where doc_id not in (select vec_id from embeddings)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("g12_note_summary", "select c_custkey, count(o_orderkey) filter (o_orderstatus = 'F') exact, count(o_orderkey) total from customer left join orders on c_custkey = o_custkey group by 1")
def _(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.expr("c_custkey = o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("exact"), F.count("o_orderkey").alias("total"))


@query("h47_reference_index", "with p as (select p_partkey k, p_partkey % 900 + 1 n, p_name from part), e as (select 2 * k o, n number, '[' || n || '] ' || p_name || '.' entry from p union all select 2 * k + 1, n + 1, '[' || (n + 1) || '] After ' || p_name || '.' from p) select number, arg_min(entry, o) entry from e group by 1")
def _(spark, d):
    from ..operators.references import bibliography_entries

    n = F.col("p_partkey") % 900 + 1
    mark = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("] "))
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(mark(n), "p_name", F.lit(". "), mark(n + 1), F.lit("After "), "p_name", F.lit(".")).alias("text"))
    e = bibliography_entries(refs).withColumn("number", F.regexp_extract("text", r"^\[(\d+)\]", 1).cast("long"))
    return e.groupBy("number").agg(F.min_by("text", F.struct("id", "n")).alias("entry"))


@query("h48_split_citations", "with p as (select p_partkey k, p_name, p_size z from part) select k, case z % 3 when 0 then ['see ', '[' || z || ']', ' ' || p_name] when 1 then ['[' || z || ']', '[7]', ' and ' || p_name || '.'] else [p_name] end pieces from p")
def _(spark, d):
    z, n = F.col("p_size"), F.col("p_name")
    mark = F.concat(F.lit("["), z.cast("string"), F.lit("]"))
    s = F.when(z % 3 == 0, F.concat(F.lit("see "), mark, F.lit(" "), n)).when(z % 3 == 1, F.concat(mark, F.lit("[7] and "), n, F.lit("."))).otherwise(n)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.filter(F.split(s, r"(?<=\])|(?=\[)"), lambda x: x != "").alias("pieces"))


@query("h50_answer_blocks", "select conv_id, turn, case turn % 3 when 0 then ['heading', 'paragraph'] when 1 then ['list', 'list', 'paragraph'] else ['paragraph'] end kinds from conversations")
def _(spark, d):
    # the text in one line, so that its own line breaks say nothing
    t = F.concat(F.lit("x "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    s = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## head\n\n"), t)).when(F.col("turn") % 3 == 1, F.concat(F.lit("- a\n* b\n\n\n"), t, F.lit("\nmore"))).otherwise(t)
    blocks = F.filter(F.flatten(F.transform(F.split(s, r"\n\s*\n"), lambda b: F.when(b.rlike(r"^\s*[-*] "), F.split(b, "\n")).otherwise(F.array(b)))), lambda b: F.trim(b) != "")
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(blocks, lambda b: F.when(b.rlike("^#{1,6} "), "heading").when(b.rlike(r"^\s*[-*] "), "list").otherwise("paragraph")).alias("kinds"))


@query("h67_validation_message", "select conv_id, turn, case when turn % 4 = 1 then '' when turn % 4 = 2 then 'unknown: E' || turn else 'unknown: E' || turn || ', E99' end message from conversations")
def _(spark, d):
    c = table(spark, d, "conversations")
    s = F.concat(F.lit("bad [E"), F.when(F.col("turn") % 4 == 1, F.lit("1")).otherwise(F.col("turn").cast("string")), F.lit("] and [E1]"), F.when(F.col("turn") % 4 == 1, F.lit("")).when(F.col("turn") % 4 == 2, F.lit("")).otherwise("[E99]"))
    u = T.unknown_markers(s, T.strings(["E1"]))
    return c.select("conv_id", "turn", F.when(F.size(u) > 0, F.concat(F.lit("unknown: "), F.array_join(u, ", "))).otherwise("").alias("message"))


TYPED = ['x {"a": @z}', "none of @n", "{oops @n}", "  "]


@query("h71_typed_failures", f"select p_partkey k, {literal(['ok', 'no_object', 'not_json', 'empty'])}[p_partkey % 4 + 1] kind from part")
def _(spark, d):
    return case_table(spark, d, TYPED).select("k", F.when(F.trim("s") == "", "empty").when(~F.col("s").rlike(r"(?s)\{.*\}"), "no_object").when(T.json_object(F.col("s")).isNull(), "not_json").otherwise("ok").alias("kind"))


@query("h72_first_answers", "select conv_id, 'f' || turn id, role || ' ' || turn latex from conversations where turn < 4 and role <> 'system'")
def _(spark, d):
    # each answer comes twice, the second time another; some aren't asked for
    c = table(spark, d, "conversations").where("role <> 'system'")
    one = lambda tail: F.struct(F.concat(F.lit("f"), F.col("turn").cast("string")).alias("id"), F.concat("role", F.lit(tail), F.col("turn").cast("string")).alias("latex"))
    j = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one(" ").alias("a"), one(" other ").alias("b")))).alias("x"))
    s = F.to_json(F.struct(F.concat(F.transform("x", lambda x: x.a), F.transform("x", lambda x: x.b)).alias("formulas")))
    e = j.select("conv_id", F.posexplode(F.from_json(s, "formulas array<struct<id:string,latex:string>>")["formulas"]).alias("pos", "e")).select("conv_id", "pos", "e.id", "e.latex")
    return S.latest(e.where(F.col("id").isin("f0", "f1", "f2", "f3")), ["conv_id", "id"], [F.col("pos")]).select("conv_id", "id", "latex")


@query("i06_ledger_append", "select event_type operation, count(*) n from events group by 1 union all select 'new', 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("operation")).unionByName(inline(spark, "operation string", [("new",)]))
    return e.groupBy("operation").agg(F.count("*").alias("n"))


@query("k02_two_table_insert", "select 'notes' as \"table\", count(*) n, sum(o_orderkey)::bigint keys from orders where o_orderstatus in ('F', 'O') union all select 'targets', count(*), sum(l_orderkey)::bigint from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus in ('F', 'O'))")
def _(spark, d):
    # notes and their targets in one commit each; a third pair is written, but its writer ends before the manifest
    root = f"{shared.folder(spark)}/notes-{shared.uuid.uuid4().hex}"
    orders, lines = table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")

    def pair(status):
        o = orders.where(F.col("o_orderstatus") == status)
        return {"notes": o, "targets": lines.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")}

    commits.append(spark, root, pair("F"))
    commits.append(spark, root, pair("O"))
    commits.write_data(root, pair("P"))
    now = commits.read(spark, root)
    one = lambda name, key: now[name].agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("table"), "n", "keys")
    return one("notes", "o_orderkey").unionByName(one("targets", "l_orderkey"))


@query("k04_by_content", "select sha256(text) h, list(doc_id order by doc_id) ids from documents group by 1 having count(*) > 1")
def _(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return g.where(F.size("ids") > 1)


@query("k06_set_resolution", "select o_orderkey, case when o_orderkey = 32 then 'REATTACHED' else o_orderstatus end state from orders")
def _(spark, d):
    return S.update(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state")), F.col("o_orderkey") == 32, state=F.lit("REATTACHED"))


@query("k07_newest_first", "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) place from orders")
def _(spark, d):
    return placed(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("k18_update_and_touch", "select p_partkey, case when p_partkey = 5 then 'seen' else p_name end p_name, case when p_partkey = 5 then 1 end touched from part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.lit(None).cast("int").alias("touched"))
    return S.update(p, F.col("p_partkey") == 5, p_name=F.lit("seen"), touched=F.lit(1))
