"""Joins between texts: containment, fuzzy titles, glossaries, carried-over values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python as py
from ..functions import text as T
from .shared import small, stored

#: Rows that are broadcast to meet all texts at most.
BOUND = 100_000


def contained_in(needles: DataFrame, needle_id: str, hay: DataFrame, hay_id: str, text: str = "text", least: int = 8) -> DataFrame:
    """(needle_id, hay_id): texts of `hay` that contain a needle of `least` characters or more.

    A needle's inner words (all but the first and last, which may be cut inside a word) must be words of the
    text; the one that fewest texts hold is the key of an equi-join, and containment is checked on what meets.
    Needles without an inner word meet all texts by a broadcast if their counted rows are within a bound, else by
    their first `least` characters.
    """
    n = needles.select(F.col(needle_id).alias("nid"), F.col(text).alias("needle")).where(F.length("needle") >= least)
    n = n.withColumn("w", F.split("needle", r"\s+")).withColumn("inner", F.array_distinct(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))).drop("w")
    h = hay.select(F.col(hay_id).alias("hid"), F.col(text).alias("hay"))
    inner = n.where(F.size("inner") > 0).select("nid", "needle", F.explode("inner").alias("key"))
    words = h.select("hid", F.explode(F.array_distinct(F.split("hay", r"\s+"))).alias("key")).join(small(inner.select("key").distinct()), "key", "left_semi")
    df = words.groupBy("key").agg(F.count("*").alias("df"))
    # a needle one of whose words no text has is in none
    rarest = inner.join(df, "key", "left").groupBy("nid", "needle").agg(F.count_if(F.col("df").isNull()).alias("lost"), F.min_by("key", F.struct("df", "key")).alias("key")).where("lost = 0").drop("lost")
    met = words.join(rarest, "key").join(h, "hid").where(F.contains("hay", F.col("needle"))).select("nid", "hid").distinct()
    short = n.where(F.size("inner") <= 0).select("nid", "needle")
    few = short.limit(BOUND + 1).count()
    if few:
        if few <= BOUND:
            rest = h.join(F.broadcast(short), F.contains("hay", F.col("needle")))
        else:
            at = F.sequence(F.lit(1), F.length("hay") - least + 1)
            parts = h.where(F.length("hay") >= least).select("hid", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("hay", i, F.lit(least))))).alias("head"))
            rest = parts.join(short.withColumn("head", F.substring("needle", 1, least)), "head").join(h, "hid").where(F.contains("hay", F.col("needle")))
        met = met.unionByName(rest.select("nid", "hid").distinct())
    return met.select(F.col("nid").alias(needle_id), F.col("hid").alias(hay_id))


def best_titles(titles: DataFrame, entries: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, entry, share): the entry with the largest share of a title's words, first entry on ties.

    Equal titles and equal entries meet once. An entry with the share has one of a title's rarest words (all but
    those that make up the share without them), so only these are joined, the first that both have counts, and
    the share is verified on the arrays.
    """
    t = titles.select("key", F.filter(F.split(T.normalize_title(F.col("title")), " "), lambda w: F.length(w) > 2).alias("tw")).where(F.size("tw") > 0)
    e = entries.select("entry", F.array_sort(F.array_distinct(F.split(T.normalize_title(F.col("text")), " "))).alias("ew")).groupBy("ew").agg(F.min("entry").alias("entry"))
    have = e.select("entry", "ew", F.explode("ew").alias("w"))
    one = t.select("tw").distinct()
    each = one.select("tw", F.explode("tw").alias("w"))
    df = have.join(small(each.select("w").distinct()), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    by = each.join(df, "w", "left").groupBy("tw").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))), lambda x: x.w).alias("by"))
    first = by.withColumn("first", F.array_distinct(F.slice("by", F.lit(1), F.size("tw") - F.ceil(F.size("tw") * F.lit(least) - 1e-9).cast("int") + 1)))
    met = first.select("tw", "first", F.explode("first").alias("w")).join(have, "w").where(F.get(F.filter("first", lambda x: F.array_contains(F.col("ew"), x)), F.lit(0)) == F.col("w"))
    share = F.size(F.filter("tw", lambda x: F.array_contains(F.col("ew"), x))) / F.size("tw")
    best = met.select("tw", F.struct((-share).alias("less"), "entry").alias("x")).groupBy("tw").agg(F.min("x").alias("x")).where(F.col("x.less") <= -least)
    return t.join(best, "tw").select("key", "x.entry", (-F.col("x.less")).alias("share"))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, value): values of an older version for rows whose text is the same but for white space; its last row wins."""
    last = old.groupBy(T.squeeze(F.col("text")).alias("k")).agg(F.max_by("value", "pos").alias("value"))
    return new.select("id", T.squeeze(F.col("text")).alias("k")).join(last, "k").select("id", "value")


def clean_terms(raw: DataFrame, limit: int = 200, most: int = 80) -> DataFrame:
    """(pos, source, target): usable terms, first of each spelling, in order."""
    t = raw.select("pos", T.squeeze(F.col("source")).alias("source"), T.squeeze(F.col("target")).alias("target"))
    t = t.where((F.col("source") != "") & (F.col("target") != "") & (F.length("source") <= most) & (F.length("target") <= most))
    t = t.withColumn("r", F.row_number().over(Window.partitionBy(F.lower("source")).orderBy("pos"))).where("r = 1")
    return t.orderBy("pos").limit(limit).select("pos", "source", "target")


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Terms added, removed or given another target."""
    a, b = old.select(F.lower("source").alias("k"), F.col("source").alias("s0"), F.col("target").alias("t0")), new.select(F.lower("source").alias("k"), F.col("source").alias("s1"), F.col("target").alias("t1"))
    return a.join(b, "k", "full").where(~F.col("t0").eqNullSafe(F.col("t1"))).select(F.coalesce("s0", "s1").alias("source"))


def _ascii_lower(c: Column) -> Column:
    """A-Z alone: other letters keep their places among what isn't a letter or digit here."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def occurrences(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term): which terms stand in a row (unique in `keys`) as a whole word, its plural included; any number of terms.

    A term's first run of letters and digits is a word of the text, in the plural too if nothing follows it; that
    is the key of an equi-join, and the term itself is checked on what meets. Terms without such a run are
    checked against all texts.
    """
    t = terms.select(F.col("source").alias("term")).distinct().withColumn("run", _ascii_lower(F.regexp_extract("term", "([A-Za-z0-9]+)", 1)))
    ends = F.trim("term").rlike("^[^A-Za-z0-9]*[A-Za-z0-9]+$")
    run = F.col("run")
    keyed = t.where("run <> ''").select("term", F.explode(F.when(ends, F.array(run, F.concat(run, F.lit("s")), F.concat(run, F.lit("es")))).otherwise(F.array(run))).alias("w"))
    words = texts.select(*keys, "text", F.explode(F.array_distinct(F.split(_ascii_lower(F.col("text")), "[^a-z0-9]+"))).alias("w"))
    hit = words.join(small(keyed), "w").where(T.term_occurs(F.col("term"), F.col("text"))).select(*keys, "term")
    other = t.where("run = ''").select("term")
    if not other.isEmpty():
        hit = hit.unionByName(texts.join(small(other), T.term_occurs(F.col("term"), F.col("text"))).select(*keys, "term"))
    return hit.distinct()


def affected(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (unique in `keys`) with any of the terms."""
    return texts.join(occurrences(texts, terms, keys).select(*keys).distinct(), keys, "left_semi")


#: A document whose units meet all of its paragraphs has so many units, paragraphs and characters at most.
MANY, FEW, LETTERS = 4096, 256, 4_000_000


def _unmapped(text: Column, chars: int, some: Column, best: Column, n: Column, least: float) -> Column:
    return F.when(F.length(text) < chars, "UNIT_TOO_SHORT").when(~some, "NO_PARAGRAPHS").when(F.coalesce(best, F.lit(0.0)) < least, "BELOW_SCORE_THRESHOLD").when(n > 1, "DUPLICATE_SOURCE_TEXT")


def map_units(units: DataFrame, paragraphs: DataFrame, least: float = 0.8, chars: int = 40, normalized: bool = False) -> DataFrame:
    """(doc, unit, paragraph, score, cause): the one paragraph of its document that a unit is, or why there is none.

    Ties leave the unit unmapped; the score of one that nothing is like enough is that of what was looked at. With
    `normalized` the texts are taken as they are: a unit that was cut before a word keeps the space at its end.
    """
    return _mapped(units, paragraphs, least, chars, normalized).drop("text")


def _mapped(units: DataFrame, paragraphs: DataFrame, least: float, chars: int, normalized: bool) -> DataFrame:
    """`map_units` with the units' texts. Texts are dealt by document once; those of large documents meet by words."""
    t = (F.col("text") if normalized else T.normalize_unit(F.col("text"))).alias("t")
    u = units.select("doc", F.struct("unit", t, *([] if normalized else ["text"])).alias("u"))
    p = paragraphs.select("doc", F.struct("paragraph", t).alias("p")).where("doc is not null and p.t <> ''")
    both = every = stored(u.unionByName(p, allowMissingColumns=True), "units")
    count = both.groupBy("doc").agg(F.count("u").alias("units"), F.count("p").alias("paragraphs"), F.sum(F.length(F.coalesce("u.t", "p.t"))).alias("letters"))
    large = stored(count.where((F.col("units") > MANY) | (F.col("paragraphs") > FEW) | (F.col("letters") > LETTERS)).select("doc"), "large")
    some = not large.isEmpty()
    if some:
        large = small(large)
        both = both.join(large, "doc", "left_anti")
    text = "t" if normalized else "text"
    each = both.groupBy("doc").agg(F.collect_list("u").alias("us"), F.collect_list("p").alias("ps"))
    each = each.withColumn("best", py.best_texts(F.transform("us", lambda x: F.when(F.length(x.t) >= chars, x.t)), F.col("ps.t"), F.lit(least)))
    each = each.select("doc", F.size("ps").alias("of"), F.explode_outer(F.transform("us", lambda x, i: F.struct(x.unit.alias("unit"), x.t.alias("t"), x[text].alias("text"), F.get("best", i).alias("b"), F.get("ps.paragraph", F.get("best", i)["at"]).alias("paragraph")))).alias("x"))
    cause = _unmapped(F.col("x.t"), chars, F.col("of") > 0, F.col("x.b.score"), F.col("x.b.n"), least)
    out = each.where("x is not null").select("doc", "x.unit", "x.text", F.when(cause.isNull(), F.col("x.paragraph")).alias("paragraph"), F.coalesce("x.b.score", F.lit(0.0)).alias("score"), cause.alias("cause"))
    if some:
        far = every.join(large, "doc", "left_semi")
        fu, fp = far.where("u is not null").select("doc", "u.*"), far.where("p is not null").select("doc", "p.*")
        texts = fu.select("doc", "unit", F.col(text).alias("text"))
        out = out.unionByName(_by_words(fu, fp, least, chars).join(texts, ["doc", "unit"]).select(*out.columns))
    return out


def _by_words(units: DataFrame, paragraphs: DataFrame, least: float, chars: int) -> DataFrame:
    """(doc, unit, paragraph, score, cause) of normalised texts `t`, without a unit meeting all paragraphs of its document.

    A paragraph with a score of `least` or more lacks few of the unit's words: 1 - least of them by overlap, the first and
    last one if it holds the unit, and if the unit holds it those of the rest's characters and two cut ones. So it holds one
    of the unit's rarest words (by the document's paragraphs), as soon as these are more than it may lack in number and in letters.
    """
    u, p = units.select("doc", "unit", F.col("t").alias("ut")), paragraphs.select("doc", "paragraph", F.col("t").alias("pt"))
    long = u.where(F.length("ut") >= chars)
    split = lambda t: F.array_distinct(F.split(t, " "))
    wu = long.select("doc", "unit", F.length("ut").alias("letters"), F.size(split("ut")).alias("words"), F.explode(split("ut")).alias("w"))
    wp = p.select("doc", "paragraph", F.explode(split("pt")).alias("w"))
    rare = Window.partitionBy("doc", "unit").orderBy(F.coalesce("df", F.lit(0)), "w").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda f: F.coalesce(f(F.length("w")).over(rare), F.lit(0))
    few = before(F.count) <= F.greatest(F.floor(F.col("words") * F.lit(1 - least + 1e-9)), F.lit(2))
    short = before(F.sum) - 2 * before(F.max) <= F.col("letters") * F.lit(1 - least + 1e-9)
    asked = wu.join(wp.groupBy("doc", "w").agg(F.count("*").alias("df")), ["doc", "w"], "left").withColumn("take", few | short).where("take and df is not null").select("doc", "unit", "w")
    met = asked.join(wp, ["doc", "w"]).select("doc", "unit", "paragraph").distinct()
    cand = met.join(long, ["doc", "unit"]).join(p, ["doc", "paragraph"]).withColumn("score", T.unit_score(F.col("ut"), F.col("pt")))
    best = cand.groupBy("doc", "unit", "score").agg(F.count("*").alias("n"), F.min("paragraph").alias("paragraph"))
    best = best.groupBy("doc", "unit").agg(F.max(F.struct("score", "n", "paragraph")).alias("b")).select("doc", "unit", F.col("b.score").alias("best"), "b.n", "b.paragraph")
    some = p.select("doc").distinct().withColumn("some", F.lit(True))
    j = u.join(best, ["doc", "unit"], "left").join(some, "doc", "left")
    cause = _unmapped(F.col("ut"), chars, F.col("some").isNotNull(), F.col("best"), F.col("n"), least)
    return j.select("doc", "unit", F.when(cause.isNull(), F.col("paragraph")).alias("paragraph"), F.coalesce("best", F.lit(0.0)).alias("score"), cause.alias("cause"))


def unit_contexts(units: DataFrame, paragraphs: DataFrame, contexts: DataFrame, version: str, normalized: bool = False) -> DataFrame:
    """(doc, unit, paragraph, context, fallback, key): each unit's context by the paragraph it is, or the plain statement that it has none.

    `contexts` is (doc, paragraph, context). The key is a digest of version, context and text, for a memo of calls.
    """
    m = _mapped(units, paragraphs, 0.8, 40, normalized).join(contexts, ["doc", "paragraph"], "left")
    digest = F.sha2(F.concat(F.lit(version), F.lit("\u0001"), F.coalesce("context", F.lit(""))), 256)
    gone = F.col("context").isNull()
    return m.select("doc", "unit", F.when(~gone, F.col("paragraph")).alias("paragraph"), "context", F.when(gone, "UNMAPPED").alias("fallback"), F.sha2(F.concat(digest, F.lit("\u0000"), "text"), 256).alias("key"))


#: The least similarity of titles that are taken for one work.
SAME_TITLE = 0.88


def _shared_bigrams(characters: Column, least: float) -> Column:
    """How many bigrams two strings of so many characters together have in common if their matching-block ratio is `least` or more.

    A ratio r over c characters means m = r c / 2 matched ones. Between two matching blocks stands at least one of the c - 2 m
    others, so there are at most c - 2 m + 1 blocks, and a block of n characters has n - 1 bigrams: m - (c - 2 m + 1) in all.
    """
    return F.ceil(characters * F.lit(1.5 * least - 1) - 1 - 1e-9)


def alike_titles(left: DataFrame, right: DataFrame, least: float = SAME_TITLE) -> DataFrame:
    """(l, r, like) of all pairs of titles (l, lt) and (r, rt) whose matching-block ratio is `least` (0.86 at least) or more.

    Equal titles meet by themselves. For all others a prefix filter is complete: bigrams, numbered by occurrence, are put in one
    order from rare to common, and two titles that share enough of them share one of the first ones. Lengths and the whole
    count of shared bigrams follow, then the ratio itself. Titles under four characters are alike only if they are equal.
    """
    from ..functions import python as py

    def texts(t: DataFrame, c: str) -> DataFrame:
        """Each title once, and its bigrams, the n-th equal one with its number."""
        g = t.where(F.length(c) > 3).select(c).distinct().withColumn("x", F.array_sort(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2)))))
        return stored(g.select(c, F.transform("x", lambda b, i: F.concat(b, (i - F.array_position("x", b)).cast("string"))).alias("g")), "titles")

    a = left.select("l", "lt").distinct()
    b = right.select("r", "rt").distinct()
    equal = a.join(b, F.col("lt") == F.col("rt")).select("l", "r", F.lit(1.0).alias("like"))
    ta, tb = texts(a, "lt"), texts(b, "rt")
    common = ta.select(F.explode("g").alias("w")).unionByName(tb.select(F.explode("g").alias("w"))).groupBy("w").agg(F.count("*").alias("df"))
    common = small(stored(common, "bigrams"))

    def prefix(t: DataFrame, c: str) -> DataFrame:
        ranked = t.select(c, F.size("g").alias("n"), F.explode("g").alias("w")).join(common, "w").groupBy(c, "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("by"))
        # the other one has at least r / (2 - r) times as many characters
        most = F.col("n") - _shared_bigrams(F.length(c) * F.lit(2 / (2 - least)), least) + 1
        return ranked.select(c, F.explode(F.slice("by", F.lit(1), most.cast("int"))).alias("x")).select(c, "x.w")

    near = F.least(F.length("lt"), F.length("rt")) * 2 >= F.lit(least - 1e-9) * (F.length("lt") + F.length("rt"))
    met = prefix(ta, "lt").join(prefix(tb, "rt"), "w").where(near & (F.col("lt") != F.col("rt"))).select("lt", "rt").distinct()
    full = met.join(ta.withColumnRenamed("g", "ga"), "lt").join(tb.withColumnRenamed("g", "gb"), "rt").where(F.size(F.array_intersect("ga", "gb")) >= _shared_bigrams(F.length("lt") + F.length("rt"), least))
    like = full.select("lt", "rt", py.title_ratio(F.col("rt"), F.col("lt")).alias("like")).where(F.col("like") >= least)
    return equal.unionByName(like.join(a, "lt").join(b, "rt").select("l", "r", "like"))


def identify(queries: DataFrame, works: DataFrame, least: float = SAME_TITLE) -> DataFrame:
    """(qid, work): the work (work, title, doi) with a query's identifier, else the one whose title is most like its own; equal similarities go to the smaller work."""
    exact = queries.where("doi is not null").select("qid", "doi").join(works.where("doi is not null").select("doi", "work"), "doi").groupBy("qid").agg(F.min("work").alias("exact"))
    rest = queries.join(exact.select("qid"), "qid", "left_anti").select(F.col("qid").alias("l"), T.normalize_title(F.col("title")).alias("lt")).where("lt <> ''")
    named = works.select(F.col("work").alias("r"), T.normalize_title(F.col("title")).alias("rt")).where("rt <> ''")
    # nothing is more alike than an equal title
    equal = rest.join(named, F.col("lt") == F.col("rt")).select("l", "r", F.lit(1.0).alias("like"))
    like = equal.unionByName(alike_titles(rest.join(equal.select("l"), "l", "left_anti"), named, least))
    best = like.groupBy(F.col("l").alias("qid")).agg(F.min(F.struct((-F.col("like")).alias("near"), F.col("r").alias("work"))).alias("b"))
    return exact.select("qid", F.col("exact").alias("work")).unionByName(best.select("qid", "b.work"))
