"""From boxes to paragraphs and sections: gaps and islands, as-of joins, nearest neighbours, hierarchies.

Everything is partitioned by document, so it scales with the number of documents; a window holds one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .folds import fold
from .shared import stored


def assemble_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc, start, end_page, text, n): consecutive prose blocks (doc, pos, page, layout, text) joined.

    A block that isn't plain breaks the chain; a plain one that isn't prose is left out without breaking it.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    b = blocks.withColumn("plain", F.col("layout") == "plain text").where(~F.col("plain") | T.looks_like_prose(F.col("text")))
    b = b.withColumn("before", F.lag(F.when(F.col("plain"), F.col("text"))).over(w))
    b = b.withColumn("new", F.when(F.col("plain") & F.coalesce(T.continues(F.col("before"), F.col("text")), F.lit(False)), 0).otherwise(1))
    b = b.withColumn("island", F.sum("new").over(w)).where("plain")
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.split(x.text, "\n", -1)))
    g = b.groupBy("doc", "island").agg(F.min("pos").alias("start"), F.min("page").alias("page"), F.max("page").alias("end_page"), lines.alias("lines"), F.count("*").alias("n"))
    return g.select("doc", "start", "page", "end_page", T.join_wrapped_lines(F.col("lines")).alias("text"), "n").where("text <> ''")


def assign_sections(paragraphs: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of join: each paragraph (doc, pos) gets the last heading (doc, pos, section) strictly before it."""
    both = paragraphs.select("doc", "pos", F.lit(None).cast("string").alias("section"), F.lit(1).alias("kind")).unionByName(headings.select("doc", "pos", F.col("section").cast("string").alias("section"), F.lit(0).alias("kind")))
    w = Window.partitionBy("doc").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("governing", F.last("section", ignorenulls=True).over(w)).where("kind = 1").select("doc", "pos", F.col("governing").alias("section"))


def body_size(blocks: DataFrame) -> DataFrame:
    """Weighted mode: the size (doc, page, size, text) with most characters; ties to the first one seen."""
    s = blocks.where("size is not null").groupBy("doc", "page", "size").agg(F.sum(F.length("text")).alias("weight"), F.min("pos").alias("first"))
    return s.groupBy("doc", "page").agg(F.max_by("size", F.struct("weight", (-F.col("first")).alias("f"))).alias("body"))


def is_heading_sized(size: Column, body: Column, margin: float = 0.4) -> Column:
    return F.coalesce(size > body + margin, F.lit(True))


def section_ends(headings: DataFrame) -> DataFrame:
    """Adds last_page: the page before the next heading, at least the heading's own; the last runs to page_count."""
    w = Window.partitionBy("doc").orderBy("pos")
    return headings.withColumn("last_page", F.greatest("page", F.coalesce(F.lead("page").over(w) - 1, "page_count")))


def hierarchy(sections: DataFrame) -> DataFrame:
    """Adds parent: the section whose number is the prefix of this one's, else the nearest earlier one of a lower level."""
    s = sections.withColumn("number", F.upper(F.nullif(F.regexp_extract("title", T.HEADING_NUMBER, 1), F.lit("")))).withColumn("level", F.coalesce(F.size(F.split("number", "[.]")), F.lit(1)))
    first = s.where("number is not null").groupBy("doc", F.col("number").alias("num")).agg(F.min_by("section", "pos").alias("named"))
    s = s.withColumn("prefix", F.nullif(F.regexp_replace("number", r"\.?[^.]*$", ""), F.lit("")))

    def above(stack: dict, level: int, section: str) -> str | None:
        # what isn't of a lower level can't stand above anything that follows
        path = stack["path"]
        while path and path[-1][0] >= level:
            path.pop()
        found = path[-1][1] if path else None
        path.append((level, section))
        return found

    stack = fold(s.withColumn("section", F.col("section").cast("string")), "doc", ["pos"], ["level", "section"], lambda: {"path": []}, above, "above", "string")
    # estimates leave out what an explode adds, so a side that grows with the rows is never to be broadcast
    j = s.join(stack.hint("merge"), ["doc", "pos"], "left").join(first.hint("merge"), (s.doc == first.doc) & (s.prefix == first.num), "left")
    return j.select(s.doc, s.pos, s.section, s.title, s.level, F.coalesce(F.when(F.col("named") != s.section, F.col("named")), F.col("above")).alias("parent"))


def nearest_in_order(rows: DataFrame, others: DataFrame) -> DataFrame:
    """(doc, pos, nearest): the other row of the document with the least distance in pages, then places, then the earlier one.

    Pages rise with places, so it is the last one before the row or the first one behind it.
    """
    side = lambda df, kind: df.select("doc", "pos", "page", F.lit(kind).alias("kind"))
    both = side(rows, 0).unionByName(side(others, 1))
    other = F.when(F.col("kind") == 1, F.struct("page", "pos"))
    w = Window.partitionBy("doc").orderBy("pos", F.desc("kind"))
    both = both.withColumn("before", F.last(other, ignorenulls=True).over(w)).withColumn("after", F.first(other, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.page") - F.col("page")).alias("a"), F.abs(F.col(f"{c}.pos") - F.col("pos")).alias("b"), F.col(f"{c}.pos").alias("nearest")))
    return both.where("kind = 0").select("doc", "pos", F.coalesce(F.least(far("before"), far("after")), far("before"), far("after"))["nearest"].alias("nearest")).where("nearest is not null")


def link_captions(blocks: DataFrame, targets: dict[str, list[str]]) -> DataFrame:
    """(doc, page, pos, caption_of): each caption's nearest element of its classes on the page, by the vertical gap."""
    pairs = [(c, t) for c, ts in targets.items() for t in ts]
    allowed = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in pairs])
    c = blocks.where(F.col("layout").isin(list(targets))).select("doc", "page", "pos", "layout", F.col("y1").alias("below"))
    e = blocks.select("doc", "page", F.col("pos").alias("epos"), F.col("layout").alias("elayout"), F.col("y0").alias("top"))
    j = c.join(e, ["doc", "page"]).where(F.array_contains(allowed, F.struct(F.col("layout").alias("c"), F.col("elayout").alias("t"))))
    return j.groupBy("doc", "page", "pos").agg(F.min_by("epos", F.struct(F.abs(F.col("top") - F.col("below")).alias("gap"), F.col("epos").alias("p"))).alias("caption_of"))


def first_line_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Point-in-box join: the first box (doc, page, box, x0..y1) that holds a line's centre (doc, page, line, cx, cy), else null."""
    l, b = lines.alias("l"), boxes.alias("b")
    j = l.join(b, F.expr("l.doc = b.doc and l.page = b.page and l.cx between b.x0 and b.x1 and l.cy between b.y0 and b.y1"), "left")
    return j.groupBy("l.doc", "l.page", "l.line").agg(F.min("b.box").alias("box"))


def title_block(blocks: DataFrame) -> DataFrame:
    """The largest title on page one, by size, then height; first one on ties."""
    t = blocks.where("page = 1 and layout = 'title' and trim(text) <> ''")
    return t.groupBy("doc").agg(F.max_by("pos", F.struct(F.coalesce("size", F.lit(0.0)).alias("s"), (F.col("y1") - F.col("y0")).alias("h"), (-F.col("pos")).alias("p"))).alias("pos"))


# Fixed values, in shares and points.
CELLS, WIDE, MIN_GUTTER, REACH = 200, 0.62, 6.0, 12.0


def column_split(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, gutter): the x between two columns of a group of blocks, where fewest of them cross; groups of one column are absent.

    Each block covers cells of the group's width; slivers and banners don't count. Of the middle three fifths the
    widest run of least covered cells is the gutter, if few enough blocks cross it and it is wide enough.
    """
    g = blocks.groupBy(*keys).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.count("*").alias("n")).where("right > left and n >= 2").withColumn("width", F.col("right") - F.col("left"))
    b = blocks.join(g, keys).withColumn("w", F.col("x1") - F.col("x0")).where("w >= greatest(10.0, 0.02 * width) and w < 0.9 * width")
    first = F.floor((F.col("x0") - F.col("left")) / F.col("width") * CELLS).cast("int")
    last = F.floor((F.col("x1") - F.col("left")) / F.col("width") * CELLS + 0.5).cast("int")
    # where the number of blocks over a cell changes: two rows a block at most; a group's first cell has how many there are
    change = lambda c, by, block: F.struct(c.cast("int").alias("c"), F.lit(by).alias("by"), F.lit(block).alias("block"))
    changes = F.array(change(F.lit(0), 0, 1), change(F.greatest(F.lit(0), first), 1, 0), change(F.least(F.lit(CELLS), F.greatest(last, first + 1)), -1, 0))
    e = b.select(*keys, "left", "width", F.explode_outer(changes).alias("e")).groupBy(*keys, "e.c").agg(F.sum("e.by").alias("by"), F.sum("e.block").alias("blocks"), F.first("left").alias("left"), F.first("width").alias("width")).where("by <> 0 or c = 0")
    group = Window.partitionBy(*keys)
    along = group.orderBy("c")
    runs = e.withColumns({"contributors": F.max("blocks").over(group), "k": F.sum("by").over(along), "a": F.greatest("c", F.lit(CELLS // 5)), "z": F.least(F.coalesce(F.lead("c").over(along), F.lit(CELLS)), F.lit(CELLS * 4 // 5))})
    runs = runs.where("contributors >= 4 and z > a").withColumn("lowest", F.min("k").over(group)).where("k = lowest and lowest <= greatest(1, cast(0.35 * contributors as int))")
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("a", "z"), F.struct((F.col("z") - F.col("a")).alias("size"), (-F.col("a")).alias("first"))).alias("x"), F.first("left").alias("left"), F.first("width").alias("width"))
    best = best.where((F.col("x.z") - F.col("x.a")) / CELLS * F.col("width") >= MIN_GUTTER)
    return best.select(*keys, (F.col("left") + (F.col("x.a") + F.col("x.z")) / 2 / CELLS * F.col("width")).alias("gutter"))


def reading_order(blocks: DataFrame, furniture: tuple[str, ...] = ("abandon",)) -> DataFrame:
    """(doc, page, pos, rank): wide blocks split a page in bands; a band is read left column first; furniture last.

    Wide is a block of a large share of the page's width, or one that reaches over the page's gutter on both sides.
    """
    page = ["doc", "page"]
    b = blocks.withColumn("rear", F.col("layout").isin(list(furniture)))
    span = Window.partitionBy(*page)
    size = F.greatest(F.max(F.when(~F.col("rear"), F.col("x1"))).over(span) - F.min(F.when(~F.col("rear"), F.col("x0"))).over(span), F.lit(1.0))
    b = b.withColumn("full", (F.col("x1") - F.col("x0")) >= WIDE * size)
    gutter = column_split(b.where("not rear and not full").select(*page, "x0", "x1"), page).withColumnRenamed("gutter", "page_gutter")
    b = b.join(gutter, page, "left").withColumn("wide", ~F.col("rear") & (F.col("full") | F.coalesce((F.col("x0") < F.col("page_gutter") - REACH) & (F.col("x1") > F.col("page_gutter") + REACH), F.lit(False))))
    w = Window.partitionBy(*page).orderBy("rear", "y0", "x0", "pos")
    b = b.withColumn("band", 2 * F.sum(F.col("wide").cast("int")).over(w) - F.col("wide").cast("int"))
    band = [*page, "band"]
    b = b.join(column_split(b.where("not rear and not wide").select(*band, "x0", "x1"), band), band, "left")
    b = b.withColumn("side", F.when(F.col("wide") | F.col("rear") | F.col("gutter").isNull() | ((F.col("x0") + F.col("x1")) / 2 < F.col("gutter")), 0).otherwise(1))
    place = lambda c: F.when(~F.col("rear"), F.col(c))
    return b.select(*page, "pos", F.row_number().over(span.orderBy("rear", "band", "side", place("y0"), place("x0"), "pos")).alias("rank"))


def resolve_targets(targets: DataFrame, paragraphs: DataFrame, blocks: DataFrame, block_classes: tuple[str, ...]) -> DataFrame:
    """(target, state, n, found): each target by its source class, among blocks of that class or among paragraphs.

    `targets` is (target, anchor, doc, page, layout, quote), the others (id, anchor, doc, page, text) and for blocks
    layout. A block's quote must lie in one block of its class and page; it is never put together from several.
    """
    of_block = F.col("layout").isin(list(block_classes))
    in_class = lambda df: df.withColumn("doc", F.concat_ws("|", "doc", "layout")).drop("layout")
    a = reattach(in_class(targets.where(of_block)), in_class(blocks.where(of_block)), parts=False)
    return a.unionByName(reattach(targets.where(~of_block).drop("layout"), paragraphs))


def reflow(blocks: DataFrame, paragraphs: DataFrame, sections: DataFrame, translations: DataFrame) -> DataFrame:
    """(doc, place, kind, id, text, translated): the reading column of headings, paragraphs with translations, crops and notices.

    `blocks` is (doc, pos, page, layout, text, caption_of) in reading order, `paragraphs` (doc, id, first_pos, section,
    text), `sections` (doc, section, heading_pos, title, is_references), `translations` (doc, id, translated). A crop
    takes its captions along; a heading stands where its block is; the first paragraph of references has a notice before it.
    """
    b = blocks.where(~F.col("layout").isin("abandon"))
    crop = F.col("layout").isin("figure", "table", "isolate_formula", "code")
    own = b.where("caption_of is not null").groupBy("doc", F.col("caption_of").alias("pos")).agg(F.min_by("text", "pos").alias("caption"))
    h = sections.select("doc", F.col("heading_pos").alias("pos"), "section", "title")
    heads = b.select("doc", "pos").join(h, ["doc", "pos"]).select("doc", "pos", F.lit(1).alias("k"), F.lit("heading").alias("kind"), F.concat(F.lit("h_"), "section").alias("id"), F.col("title").alias("text"), F.lit(None).cast("string").alias("translated"))
    crops = b.where(crop).join(h.select("doc", "pos"), ["doc", "pos"], "left_anti").join(own, ["doc", "pos"], "left").select("doc", "pos", F.lit(1).alias("k"), F.lit("crop").alias("kind"), F.concat(F.lit("c_"), F.col("pos").cast("string")).alias("id"), F.col("caption").alias("text"), F.lit(None).cast("string").alias("translated"))
    p = paragraphs.join(sections.select("doc", "section", "is_references"), ["doc", "section"], "left").join(translations, ["doc", "id"], "left")
    pairs = p.select("doc", F.col("first_pos").alias("pos"), F.lit(1).alias("k"), F.lit("pair").alias("kind"), F.concat(F.lit("p_"), "id").alias("id"), "text", "translated")
    notices = p.where("is_references").groupBy("doc", "section").agg(F.min("first_pos").alias("pos")).select("doc", "pos", F.lit(0).alias("k"), F.lit("notice").alias("kind"), F.concat(F.lit("n_"), "section").alias("id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("translated"))
    every = heads.unionByName(crops).unionByName(pairs).unionByName(notices)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "k", "kind", "id"))).drop("pos", "k")


def outline(sections: DataFrame) -> DataFrame:
    """(section, depth, path): the tree of (section, parent, ord) from its roots, of any depth; orphans are roots, cycles are left out.

    Each round doubles the distance that a section has climbed, so there are as many as the depth's logarithm; the
    last row of every chain that ends is reached in each, so a round that ends none leaves cycles alone.
    """
    s = sections.select("section", "parent", "ord")
    ids = s.select(F.col("section").alias("pid"))
    now = s.join(ids, s.parent == ids.pid, "left").select("section", F.col("pid").alias("up"), F.lit(0).alias("depth"), F.array("ord").alias("path"))
    left = None
    while True:
        now = stored(now, "outline")
        open_ = now.where("up is not null").count()
        if not open_ or open_ == left:
            return now.where("up is null").select("section", "depth", "path")
        left = open_
        n, a = now.alias("n"), now.select(F.col("section").alias("pid"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("path").alias("head")).alias("a")
        j = n.join(a, F.expr("n.up = a.pid"), "left")
        now = j.select("n.section", F.col("a.next").alias("up"), (F.col("n.depth") + F.coalesce(F.col("a.more") + 1, F.lit(0))).alias("depth"), F.when(F.col("a.head").isNull(), F.col("n.path")).otherwise(F.concat("a.head", "n.path")).alias("path"))


#: A page, and how many paragraphs it has at most if its quotes meet all of them.
PAGE, FEW = ["doc", "page"], 64


def _holding(needles: DataFrame, nid: str, needle: str, hays: DataFrame, hid: str, hay: str) -> DataFrame:
    """(doc, page, nid, hid): the texts `hay` of a page that hold a `needle` of it, without meeting all of them.

    A needle's words but the first and last are words of the text, and the rarest of these on the page is the key. If there is
    none, its longest word lies within a word of the text: such words are found among the page's distinct ones, by the last
    1, 2, 4, 8 or 16 characters.
    """
    n = needles.select(*PAGE, F.col(nid).alias("n"), F.col(needle).alias("x")).withColumn("ws", F.split("x", " "))
    h = hays.select(*PAGE, F.col(hid).alias("h"), F.col(hay).alias("y"))
    words = h.select(*PAGE, "h", F.explode_outer(F.array_distinct(F.split("y", " "))).alias("w"))
    each = words.groupBy(*PAGE, "w").agg(F.count("*").alias("df"))
    inner = n.where(F.size("ws") > 2).select(*PAGE, "n", F.explode_outer(F.array_distinct(F.slice("ws", F.lit(2), F.size("ws") - 2))).alias("w"))
    # a needle one of whose words the page doesn't have is in none
    key = inner.join(each, [*PAGE, "w"], "left").groupBy(*PAGE, "n").agg(F.count_if(F.col("df").isNull()).alias("lost"), F.min_by("w", F.struct("df", "w")).alias("w")).where("lost = 0").drop("lost")
    short = n.where(F.size("ws") <= 2).select(*PAGE, "n", F.array_max(F.transform("ws", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"].alias("part"))
    long = F.length("part")
    size = F.when(long >= 16, 16).when(long >= 8, 8).when(long >= 4, 4).otherwise(F.least(long, F.lit(2)))
    parts = stored(short.where("part <> ''").withColumn("size", size).withColumn("gram", F.expr("right(part, size)")), "parts")
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())
    if sizes:
        cut = lambda k: F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - k + 1, F.lit(1))), lambda i: F.substring("w", i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        grams = F.array_distinct(F.flatten(F.array(*[cut(k) for k in sizes])))
        within = each.select(*PAGE, "w", F.explode_outer(grams).alias("gram")).where("gram is not null")
        key = key.unionByName(parts.join(within, [*PAGE, "gram"]).where(F.contains("w", F.col("part"))).select(*PAGE, "n", "w"))
    met = words.join(key, [*PAGE, "w"]).select(*PAGE, "n", "h").distinct().join(n.drop("ws"), [*PAGE, "n"]).join(h, [*PAGE, "h"])
    return met.where(F.contains("y", F.col("x"))).select(*PAGE, F.col("n").alias(nid), F.col("h").alias(hid))


def reattach(targets: DataFrame, paragraphs: DataFrame, parts: bool = True) -> DataFrame:
    """(target, state, n, found): exact anchor, else the quote inside one paragraph of its page, else (with `parts`) one inside the quote.

    `targets` is (target, anchor, doc, page, quote), `paragraphs` (id, anchor, doc, page, text); quotes meet only
    their own page's paragraphs, by an equi-join; on pages of many paragraphs only those with a word that they must have.
    """
    t = targets.withColumn("needle", T.canonical_source_text(F.col("quote")))
    p = paragraphs.withColumn("canon", T.canonical_source_text(F.col("text")))
    exact = t.join(p.select(F.col("anchor").alias("pa"), "id"), F.expr("anchor = pa")).groupBy("target").agg(F.min("id").alias("exact"))
    asked = t.where("needle <> ''").select(*PAGE, "needle").distinct()
    own = p.select(*PAGE, "id", "canon")
    many = stored(own.groupBy(*PAGE).count().where(F.col("count") > FEW).select(*PAGE), "pages")
    met = asked.join(own if many.isEmpty() else own.join(many, PAGE, "left_anti"), PAGE)
    met = met.withColumns({"hold": F.contains("canon", F.col("needle")), "within": F.lit(parts) & (F.col("canon") != "") & F.contains("needle", F.col("canon"))}).select(*PAGE, "needle", "id", "hold", "within")
    if not many.isEmpty():
        quotes, rows = stored(asked.join(many, PAGE, "left_semi"), "quotes"), stored(own.join(many, PAGE, "left_semi"), "rows")
        held = lambda found, hold: found.select(*PAGE, "needle", "id", F.lit(hold).alias("hold"), F.lit(not hold).alias("within"))
        met = met.unionByName(held(_holding(quotes, "needle", "needle", rows, "id", "canon"), True))
        if parts:
            met = met.unionByName(held(_holding(rows.where("canon <> ''"), "id", "canon", quotes, "needle", "needle"), False))
    c = met.groupBy(*PAGE, "needle").agg(F.count_if("hold").alias("holding"), F.min(F.when(F.col("hold"), F.col("id"))).alias("holder"), F.count_if("within").alias("parts"), F.min(F.when(F.col("within"), F.col("id"))).alias("part"))
    r = t.join(exact, "target", "left").join(c, [*PAGE, "needle"], "left").na.fill(0, ["holding", "parts"])
    state = F.when(F.col("exact").isNotNull(), "EXACT").when(F.col("holding") == 1, "REATTACHED").when(F.col("holding") > 1, "AMBIGUOUS").when(F.col("parts") == 1, "REATTACHED").when(F.col("parts") > 1, "AMBIGUOUS").otherwise("ORPHANED")
    found = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("holding") == 1, F.col("holder")).when((F.col("holding") == 0) & (F.col("parts") == 1), F.col("part"))
    return r.select("target", state.alias("state"), F.greatest("holding", F.when(F.col("holding") == 0, F.col("parts")).otherwise(0)).alias("n"), found.alias("found"))


def number_key(number: Column) -> Column:
    """Dotted section numbers in natural order: by parts, numbers by value and before letters."""
    return F.transform(F.split(number, "[.]"), lambda p: F.struct((~p.rlike(r"^\d+$")).alias("letter"), F.when(p.rlike(r"^\d+$"), F.lpad(p, 9, "0")).otherwise(p).alias("p")))


def ancestors(sections: DataFrame) -> DataFrame:
    """(section, anc, k): every ancestor of each section (section, parent), k steps up; a parent without a row is the last.

    A level is a join of the level before; a section that is its own ancestor ends its chain, so cycles end too.
    """
    up = sections.select(F.col("section").alias("anc"), F.col("parent").alias("next"))
    level = stored(sections.where("parent is not null").select("section", F.col("parent").alias("anc"), F.lit(1).alias("k")), "ancestors")
    out, first = level, 1
    while True:
        level = stored(level.where("anc <> section").join(up.hint("merge"), "anc").where("next is not null").select("section", F.col("next").alias("anc"), (F.col("k") + 1).alias("k")), "ancestors")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
        first += 1
        if first % 20 == 0:
            # a chain that meets a cycle of others goes on for ever: what it has met before is left out
            level = level.join(out.where(F.col("k") < first).select("section", "anc").hint("merge"), ["section", "anc"], "left_anti")
