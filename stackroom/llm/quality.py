"""Operator 10, quality rules: outlier fences from mergeable quantile sketches per language and source.

`text_stats` measures whole texts. `fences` builds, for each (lang, source), a mergeable sketch of each
measure: counts in logarithmic bins (relative error ALPHA), which add up over any partitioning, so hot
sources are pre-aggregated before the shuffle and the result doesn't depend on the order of rows. The
quartiles read from a group's sketch give the fence q75 + SPREAD * max(q75 - q25, floor). Groups with
fewer than MIN_GROUP rows use the sketch of their language, then that of all rows; a group's fence never
exceeds LEAST_OVER times the fence of all rows, so that a source that is mostly junk doesn't excuse it.
`judge` joins rows to their fences and adds the verdicts.

Defined cases: a null text has no words and fails the base rule; null lang or source is a group of its
own; repeated rows and ids are judged row by row; a measure equal to its fence is kept, and texts with equal
measures get equal verdicts; a very long text is measured whole, in steps of a fixed size; an empty table
gives an empty table; further columns of the input stay, and an input column with the name of an output
column is replaced by the output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, byte_texts, in_word, load, mix, ship, sliced, small_join, store, text_buffer, word_hashes

#: Relative error of the sketch's bins; bin of x > 0: ceil(log_GAMMA(x)).
ALPHA = 0.02
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Below this a measure counts as zero.
TINY = 1e-6
SPREAD = 4.0
MIN_GROUP = 30
LEAST_OVER = 1.5
#: Measures with an upper fence and the least spread each is granted.
MEASURES = {"symbols_per_word": 0.05, "dup_line_share": 0.1, "repeat_share": 0.1, "mean_word_chars": 1.0}
SYMBOLS = b"#*$%&|<>"
STATS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")])
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _repeat_words(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document the positions inside a 3-word window that occurs twice or more in its text."""
    if len(h) < 3:
        return np.zeros(n_docs, np.int64)
    key = mix(mix(mix(h[:-2]) + h[1:-1]) * np.uint64(3) + h[2:] + mix(doc[:-2].astype(np.uint64) + np.uint64(7)))
    inside = doc[:-2] == doc[2:]
    at = np.flatnonzero(inside)
    key = key[at]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    mark = np.zeros(len(h), bool)
    for k in range(3):
        mark[hit + k] = True
    return np.bincount(doc[mark], minlength=n_docs).astype(np.int64)


def _by_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask has."""
    at = np.flatnonzero(mask)
    return np.diff(np.searchsorted(at, off))


def _stats_of(texts: pa.Array) -> pa.Array:
    h, n = word_hashes(texts, fold=False)
    rep = _repeat_words(h, np.repeat(np.arange(len(n)), n), len(n))
    buf, off = text_buffer(texts)
    chars, syms = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for a in range(0, len(buf), STEP_BYTES):
        part, cut = buf[a : a + STEP_BYTES], np.clip(off - a, 0, min(STEP_BYTES, len(buf) - a))
        chars += _by_text(in_word(part) & ((part & 0xC0) != 0x80), cut)
        syms += _by_text(IS_SYMBOL.take(part), cut)
    dups, lines_n = [], []
    for t in byte_texts(texts):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines_n.append(len(lines))
        dups.append(len(lines) - len(set(lines)))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, chars, syms, dups, lines_n, rep)], names=STATS.names)


def _stats(texts: pa.Array) -> pa.Array:
    b = pa.RecordBatch.from_arrays([texts], ["t"])
    out = [_stats_of(x.column("t")) for x in sliced([b], "t", 1 << 20)]
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(n, pa.int64()) for n in STATS.names]))


def text_stats(docs: DataFrame, text: str = "text", name: str = "__q") -> DataFrame:
    """Add a struct of whole-text counts under `name`."""
    ship(docs.sparkSession)

    def stats(x: pa.Array) -> pa.Array:
        return _stats(x)

    return docs.withColumn(name, F.arrow_udf(stats, STATS).asNondeterministic()(F.col(text)))


def _measures(q: str = "__q") -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(f"{q}.{a}").cast("double"), F.col(f"{q}.{b}")), F.lit(0.0))
    return {"symbols_per_word": per("n_symbols", "n_words"), "dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "mean_word_chars": per("word_chars", "n_words")}


def base_failed(q: str = "__q") -> Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def _bin(x: Column) -> Column:
    return F.when(x <= TINY, F.lit(-(1 << 20))).otherwise(F.ceil(F.log(x) / F.lit(float(np.log(GAMMA))))).cast("int")


def _bin_value(b: Column) -> Column:
    return F.when(b == -(1 << 20), F.lit(0.0)).otherwise(F.lit(2.0 / (1 + GAMMA)) * F.pow(F.lit(GAMMA), b))


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the mergeable sketch of each group; unions add up."""
    long = stats.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), _bin(v).alias("bin")) for k, v in _measures().items()])).alias("m"))
    return long.groupBy("lang", "source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def _quartiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles of merged sketches by `keys`, from the few hundred bins of each."""
    merged = sk.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    bins = merged.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("b"), F.sum("n").alias("total"))
    # running totals over a sketch's bins, whose number is bounded by the range of the measure
    cum = F.expr("transform(b, (x, i) -> struct(x.bin as bin, aggregate(slice(b, 1, i + 1), 0L, (s, y) -> s + y.n) as c))")
    out = bins.withColumn("c", cum)
    for name, p in (("q25", 0.25), ("q75", 0.75)):
        out = out.withColumn(name, _bin_value(F.expr(f"element_at(filter(c, x -> x.c >= ceil({p} * total)), 1).bin")))
    return out.select(*keys, "measure", "total", "q25", "q75")


def fences(sk: DataFrame) -> DataFrame:
    """(lang, source, f): f maps each measure to its upper fence for every (lang, source) that occurs."""
    floor = F.element_at(F.create_map(*[F.lit(y) for x in MEASURES.items() for y in x]), F.col("measure"))
    fence = F.col("q75") + SPREAD * F.greatest(F.col("q75") - F.col("q25"), floor)
    own = _quartiles(sk, ["lang", "source"]).withColumn("own", F.when(F.col("total") >= MIN_GROUP, fence)).select("lang", "source", "measure", "own")
    by_lang = _quartiles(sk, ["lang"]).withColumn("by_lang", F.when(F.col("total") >= MIN_GROUP, fence)).select("lang", "measure", "by_lang")
    overall = _quartiles(sk, []).withColumn("overall", fence).select("measure", "overall")
    o, g, a = own.alias("o"), by_lang.alias("g"), overall.alias("a")
    j = o.join(g, F.expr("o.lang <=> g.lang and o.measure = g.measure"), "left").join(a, F.expr("o.measure = a.measure"), "left")
    value = F.least(F.coalesce("own", "by_lang", "overall"), LEAST_OVER * F.col("overall"))
    return j.select("o.lang", "o.source", "o.measure", value.alias("v")).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", "v"))).alias("f"))


def thresholds(stats: DataFrame) -> DataFrame:
    """The fences that rows with (lang, source, __q) set; junk by the base rule doesn't shape them."""
    return small_join(store(fences(sketches(stats.where(~base_failed()))), "fences"))


def judge_measured(stats: DataFrame, fence: DataFrame, keep_stats: bool = True) -> DataFrame:
    """Rows with `__q` and their verdicts by the fences; `__q` becomes its counts, or goes."""
    d = stats.alias("d")
    j = d.join(fence.alias("t"), F.expr("d.lang <=> t.lang and d.source <=> t.source"), "left")
    ok = F.lit(True)
    for k, v in _measures("d.__q").items():
        ok = ok & (v <= F.coalesce(F.element_at(F.col("t.f"), k), F.lit(float("inf"))))
    kept = (~base_failed("d.__q")) & ok
    mine = {n: F.col(f"d.__q.{n}") for n in STATS.names} if keep_stats else {}
    mine |= {"base_failed": base_failed("d.__q"), "kept": kept} if keep_stats else {"__kept": kept}
    return j.select(*[F.col(f"d.`{c}`") for c in stats.columns if c not in mine and c != "__q"], *[v.alias(k) for k, v in mine.items()])


def judge(docs: DataFrame, keep_stats: bool = True) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, ...) with their counts, base_failed and kept.

    Texts are measured twice, for the fences and for the verdicts: writing whole rows in between would cost more.
    """
    fence = thresholds(text_stats(docs.select("lang", "source", "text")).drop("text"))
    return judge_measured(text_stats(docs), fence, keep_stats)


def judge_counts(docs: DataFrame) -> DataFrame:
    """As `judge`, but without the text, which is then read once: the rows' counts are stored."""
    stats = store(text_stats(docs).drop("text"), "counts")
    return judge_measured(stats, thresholds(stats))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with the columns of the input."""
    return judge(docs, keep_stats=False).where("__kept").drop("__kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judge_counts(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def _oracle() -> str:
    g, big = repr(float(np.log(GAMMA))), 1 << 20
    quart = lambda keys, sk: f"select {keys}measure, sum(n) total, min(v) filter (c >= ceil(0.25 * t)) q25, min(v) filter (c >= ceil(0.75 * t)) q75 from (select *, case when bin = -{big} then 0.0 else {2.0 / (1 + GAMMA)!r} * pow({GAMMA!r}, bin) end v, sum(n) over (partition by {keys}measure order by bin) c, sum(n) over (partition by {keys}measure) t from (select {keys}measure, bin, sum(n) n from {sk} group by all)) group by all"
    floor = "case measure " + " ".join(f"when '{k}' then {v!r}" for k, v in MEASURES.items()) + " end"
    fence = f"q75 + {SPREAD!r} * greatest(q75 - q25, {floor})"
    ok = " and ".join(f"coalesce(m_{k} <= max(case when measure = '{k}' then v end), true)" for k in MEASURES)
    return f"""
with b as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from b),
tri as (select rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] g from (select rid, w, unnest(range(1, len(w) - 1)) p from w)),
rep as (select rid, count(distinct p + k) r from (select rid, p, count(*) over (partition by rid, g) c from tri), (values (0), (1), (2)) v(k) where c > 1 group by rid),
s as (select w.rid, doc_id, lang, source, len(w)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, len(l)::bigint n_lines, coalesce(r, 0)::bigint n_repeat_words from w left join rep using (rid)),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, coalesce(n_symbols::double / nullif(n_words, 0), 0) m_symbols_per_word, coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) m_dup_line_share,
  coalesce(n_repeat_words::double / nullif(n_words, 0), 0) m_repeat_share, coalesce(word_chars::double / nullif(n_words, 0), 0) m_mean_word_chars from s),
long as (select lang, source, replace(k, 'm_', '') measure, case when x <= {TINY!r} then -{big} else ceil(ln(x) / {g})::int end bin from (unpivot (select lang, source, m_symbols_per_word, m_dup_line_share, m_repeat_share, m_mean_word_chars from m where not base_failed) on m_symbols_per_word, m_dup_line_share, m_repeat_share, m_mean_word_chars into name k value x)),
sk as (select lang, source, measure, bin, count(*) n from long group by all),
own as ({quart("lang, source, ", "sk")}), by_lang as ({quart("lang, ", "sk")}), overall as ({quart("", "sk")}),
f as (select o.lang, o.source, o.measure, least(coalesce(case when o.total >= {MIN_GROUP} then o.f end, case when g.total >= {MIN_GROUP} then g.f end, a.f), {LEAST_OVER!r} * a.f) v
  from (select *, {fence} f from own) o left join (select *, {fence} f from by_lang) g on o.lang is not distinct from g.lang and o.measure = g.measure left join (select *, {fence} f from overall) a on o.measure = a.measure),
j as (select rid, {ok} ok from m left join f on m.lang is not distinct from f.lang and m.source is not distinct from f.source group by rid, {", ".join(f"m_{k}" for k in MEASURES)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and ok as kept, lang, source from m join j using (rid)
"""


OP10_SQL = _oracle()
