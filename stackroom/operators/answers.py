"""From a question to a checked answer: expansion of the question, reply validation, one bounded repair."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import providers as P
from ..functions import text as T
from . import search as S

# Fixed values.
STATUSES = ("answered", "partial", "insufficient_evidence")
MOST_ENTITIES, LEAST_MENTIONS = 3, 2


def expand(questions: DataFrame, glossary: DataFrame, acronyms: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(qid, place, term, expansion, source): terms of a question that the paper itself pairs with another, longest first.

    `questions` is (qid, q), `glossary` (pos, source_term, translation), `acronyms` (pos, acronym, expansion), both
    ways each; a pair without its second part is no pair. A term inside one that comes before it is left out.
    `entities` (name, kind, mentions) follow: those of a kind that the question names, most mentioned first.
    The terms are one paper's, a broadcast side.
    """

    def both(df: DataFrame, a: str, b: str, source: str, rank: int) -> DataFrame:
        pair = lambda x, y, k: F.struct(F.col(x).alias("term"), F.col(y).alias("expansion"), F.lit(k).alias("k"))
        first, second = ((b, a) if source == "glossary" else (a, b))
        d = df.where(F.coalesce(F.col(b), F.lit("")) != "")
        return d.select("pos", F.explode(F.array(pair(first, second, 0), pair(second, first, 1))).alias("p"), F.lit(source).alias("source"), F.lit(rank).alias("rank")).select("p.term", "p.expansion", "source", F.struct((-F.length("p.term")).alias("l"), "rank", "pos", "p.k").alias("ord"))

    pairs = both(glossary, "source_term", "translation", "glossary", 0).unionByName(both(acronyms, "acronym", "expansion", "acronym", 1))
    pairs = pairs.withColumn("needle", F.trim(F.lower("term"))).where(F.length("needle") >= 2)
    met = questions.join(F.broadcast(pairs), F.contains(F.lower("q"), F.col("needle")))
    # whatever holds a term and was left out is itself held by one that wasn't, so all earlier ones may be asked
    rows = met.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ord", "needle", "term", "expansion", "source"))).alias("r"))
    kept = F.expr("filter(r, (x, i) -> not exists(slice(r, 1, i), y -> contains(y.needle, x.needle)))")
    out = rows.select("qid", F.posexplode(kept).alias("place", "x")).select("qid", "place", "x.term", "x.expansion", "x.source")
    if entities is None:
        return out
    words = F.transform(T.normalize_terms(F.col("q")), lambda w: F.lower(F.btrim(w, F.lit('"'))))
    singular = F.transform(words, lambda w: F.when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    named = questions.select("qid", F.explode(F.array_union(words, singular)).alias("kind"))
    e = entities.where((F.col("mentions") >= LEAST_MENTIONS) & (F.trim("name") != "")).withColumn("kind", F.lower("kind"))
    e = named.join(F.broadcast(e), "kind").withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("mentions"), F.lower("name"), "name"))).where(F.col("r") <= MOST_ENTITIES)
    return out.unionByName(e.select("qid", (F.col("r") + 999).cast("int").alias("place"), F.col("name").alias("term"), F.col("name").alias("expansion"), F.lit("entity").alias("source")))


def strip_fence(c: Column) -> Column:
    t = F.trim(c)
    body = F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise("")
    return F.when(F.startswith(t, F.lit("```")), F.trim(F.regexp_replace(body, r"```\s*$", ""))).otherwise(t)


def parse_reply(reply: Column) -> Column:
    """struct(status, answer, aspects, problem): a reply as a verdict on the evidence, or what is wrong with it (problem isn't empty then)."""
    c = strip_fence(F.coalesce(reply, F.lit("")))
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    blank = lambda s: F.coalesce(F.trim(s), F.lit("")) == ""

    def judge(v: Column) -> Column:
        status, answer = F.try_variant_get(v, "$.status", "string"), F.try_variant_get(v, "$.answer", "string")
        aspects = F.try_variant_get(v, "$.unanswered_aspects", "array<string>")
        listed = F.when(kind(v, "$.unanswered_aspects").isNull(), True).otherwise(F.coalesce(kind(v, "$.unanswered_aspects").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)))
        problem = (
            F.when(v.isNull(), "not_json")
            .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_object")
            .when(~F.coalesce(status.isin(*STATUSES), F.lit(False)) | (kind(v, "$.status") != "STRING"), "bad_status")
            .when(F.coalesce(kind(v, "$.answer"), F.lit("STRING")) != "STRING", "answer_not_text")
            .when(~listed, "aspects_not_texts")
            .when(status == "insufficient_evidence", "")
            .when(blank(answer), "empty_answer")
            .when(F.size(T.extract_markers(F.coalesce(answer, F.lit("")))) == 0, "no_evidence_cited")
            .when((status == "partial") & (F.size(F.filter(F.coalesce(aspects, F.array().cast("array<string>")), lambda a: ~blank(a))) == 0), "no_aspect_named")
            .otherwise("")
        )
        ok = problem == ""
        return F.struct(F.when(ok, status).alias("status"), F.when(ok, F.coalesce(answer, F.lit(""))).alias("answer"), F.when(ok, F.coalesce(aspects, F.array().cast("array<string>"))).alias("aspects"), problem.alias("problem"))

    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("array<string>").alias("aspects"), F.lit("empty").alias("problem"))
    whole = F.try_parse_json(c)
    return F.when(F.trim(F.coalesce(reply, F.lit(""))) == "", none).otherwise(T.let(F.coalesce(whole, F.when(inner != "", F.try_parse_json(inner))), judge))


def ask(questions: DataFrame, provider: P.Provider) -> DataFrame:
    """(…, status, answer, repaired, code): one answer for each (qid, prompt, markers), one repair if it can't be used, else an abstention.

    A reply that parses must cite known `markers` alone. What the repair doesn't mend isn't shown.
    """

    def checked(df: DataFrame, reply: str, into: str) -> DataFrame:
        df = df.withColumn(into, parse_reply(F.col(reply)))
        unknown = F.size(F.array_except(T.extract_markers(F.coalesce(f"{into}.answer", F.lit(""))), "markers")) > 0
        return df.withColumn(into, F.when((F.col(f"{into}.problem") == "") & unknown, F.col(into).withField("problem", F.lit("unknown_marker"))).otherwise(F.col(into)))

    first = checked(P.call(questions, provider, "prompt", "r1"), "r1", "p1")
    again = F.when(F.col("p1.problem") != "", F.concat("prompt", F.lit("\nproblem: "), "p1.problem"))
    both = checked(P.call(first.withColumn("again", again), provider, "again", "r2"), "r2", "p2")
    p = F.when(F.col("p1.problem") == "", F.col("p1")).otherwise(F.col("p2"))
    bad = p["problem"] != ""
    code = F.when(bad, F.when(p["problem"].isin("empty", "not_json", "not_object"), "MALFORMED_OUTPUT").otherwise("UNGROUNDED_OUTPUT")).when(p["status"] == "insufficient_evidence", "INSUFFICIENT").otherwise("OK")
    return both.select(*questions.columns, F.when(bad, "insufficient_evidence").otherwise(p["status"]).alias("status"), F.when(bad, "").otherwise(p["answer"]).alias("answer"), (F.col("p1.problem") != "").alias("repaired"), code.alias("code"))


def answer(spark: SparkSession, chunks: DataFrame, variants: DataFrame, question: str, provider: P.Provider, room: int = 24_000, rewrite: Callable[[str], list[tuple[str, str]]] | None = None) -> DataFrame:
    """One row (question, status, answer, code, evidence, rewritten): retrieve, rewrite if nothing came, budget, ask, check, repair."""
    found = S.retrieve(chunks, variants, question)
    rewritten = False
    if rewrite is not None and found.isEmpty():
        more = rewrite(question)
        rewritten = bool(more)
        if more:
            found = S.retrieve(chunks, variants.unionByName(spark.createDataFrame(more, variants.schema)), question)
    # few rows: the best chunks and their neighbours
    texts = found.join(chunks.select("chunk_id", "text"), "chunk_id")
    used = F.sum(F.length("text")).over(Window.orderBy("place"))
    kept = texts.withColumn("used", used).where((F.col("used") <= room) | (F.col("place") == 1)).withColumn("marker", F.concat(F.lit("E"), F.col("place").cast("string")))
    packet = kept.agg(F.array_sort(F.collect_list(F.struct("place", "marker", "chunk_id", "text"))).alias("e"))
    line = F.transform("e", lambda x: F.concat(F.lit("["), x.marker, F.lit("] "), x.text))
    q = packet.select(F.lit(question).alias("question"), F.expr("e.marker").alias("markers"), F.expr("e.chunk_id").alias("evidence"), F.concat(F.lit(f"question: {question}\n"), F.array_join(line, "\n")).alias("prompt"))
    none = F.size("markers") == 0
    a = ask(q.where(~none), provider).select("question", "status", "answer", "code", "evidence")
    empty = q.where(none).select("question", F.lit("insufficient_evidence").alias("status"), F.lit("").alias("answer"), F.lit("NO_EVIDENCE").alias("code"), "evidence")
    return a.unionByName(empty).withColumn("rewritten", F.lit(rewritten))


def cite_first(prompt: str) -> str:
    """A stand-in for a model: answers by the first piece of evidence; a repair adds what was missing."""
    return json.dumps({"status": "answered", "answer": "See [E1]."})


def analyse(paragraphs: DataFrame, provider: P.Provider) -> DataFrame:
    """(doc, source, target, units_of, units): one call for each unit of a document, its terms merged.

    `paragraphs` is (doc, unit, pos, text). Of a term's spellings and translations those of the first unit count;
    the units that name it are listed in order.
    """
    u = paragraphs.groupBy("doc", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), " ").alias("text"))
    r = P.call(u, provider)
    n = u.groupBy("doc").agg(F.count("*").alias("units"))
    t = r.select("doc", "unit", F.posexplode(F.from_json(T.json_object(F.col("reply")), "terms array<struct<source:string,target:string>>")["terms"]).alias("at", "t"))
    t = t.where("t.source <> ''")
    m = t.groupBy("doc", F.lower("t.source").alias("k")).agg(F.min(F.struct("unit", "at", "t")).alias("first"), F.array_sort(F.collect_set("unit")).alias("units_of"))
    return m.join(n, "doc").select("doc", "first.t.source", "first.t.target", "units_of", "units")
