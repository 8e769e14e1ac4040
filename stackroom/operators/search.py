"""Scoped lexical and dense retrieval: inverted index, BM25, rank fusion, neighbours.

Statistics come from the whole corpus of a paper, the scope filters candidates only; every ranking ends in a
unique key. A query's words are few, so its variants are a small broadcast side; postings are shuffled by
word only for the words asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import delete, exists, small, stored

# Fixed values.
K1, B, TITLE_WEIGHT, BODY_WEIGHT, LEAST_IDF = 1.2, 0.75, 5.0, 1.0, 1e-6
RRF_K, CANDIDATES, ALPHA = 60, 20, 0.05
#: Words of a question that go into the plan as constants at most.
WORDS = 1000
#: Bits of a chunk's id within a block of postings, words of text behind each file of an index, and blocks of a variant that are read first.
BITS, EACH, FIRST = 10, 2 << 20, 16


def chunk_view(paragraphs: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """(chunk_id, title, text): paragraphs and captions that aren't blank, with the section's title as a column."""
    out = paragraphs if captions is None else paragraphs.unionByName(captions)
    return out.where(F.trim("text") != "")


def _tokens(chunks: DataFrame, *keep: str) -> DataFrame:
    return chunks.select("chunk_id", *keep, T.fts_tokens(F.coalesce("title", F.lit(""))).alias("a"), T.fts_tokens(F.col("text")).alias("b"))


def _tagged(chunks: DataFrame, only: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, dl, t): a chunk's tokens as structs of word and weight; with `only`, the words of a query alone."""
    some = (lambda c: F.filter(c, lambda w: w.isin(only))) if only is not None else (lambda c: F.col(c))
    tag = lambda c, k: F.transform(some(c), lambda w: F.struct(w.alias("w"), F.lit(k).alias("k")))
    return _tokens(chunks, *keep).select("chunk_id", *keep, (F.size("a") + F.size("b")).alias("dl"), F.concat(tag("a", TITLE_WEIGHT), tag("b", BODY_WEIGHT)).alias("t"))


def _postings(tagged: DataFrame, *keep: str) -> DataFrame:
    # the outer form: from the plain one the optimizer infers a filter that computes the array a second time
    return tagged.select("chunk_id", *keep, "dl", F.explode_outer("t").alias("t")).where("t is not null").groupBy("chunk_id", *keep, "dl", F.col("t.w").alias("word")).agg(F.sum("t.k").alias("f"))


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, word, f): weighted frequency of each word in title and body, and the chunk's tokens."""
    return _postings(_tagged(chunks))


SIGNATURE = "words-by-unicode; title 5, body 1"


def _part(avgdl: Column) -> Column:
    """A word's share of a chunk's score, but for its idf."""
    return F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / avgdl))


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def ensure_index(spark: SparkSession, path: str, chunks: DataFrame, content_hash: str, version: str, force: bool = False) -> bool:
    """Write the inverted index of `chunks` under `path` unless one of the same content, signature and version is there; says whether it was written.

    A row is a block: the postings of a word in chunks whose ids differ in the last BITS bits alone, as offsets, frequencies
    and lengths, with the best share of a score among them. So a frequent word is many rows, in as many tasks and files as
    it needs. Chunks are dealt by block and rows are sorted within a file, so a reader's filter on words reads these words'
    pages of every file. The row of meta data is written last, so a half-written index is stale.
    """
    meta = f"{path}/meta"
    if not force and exists(spark, meta):
        stored_ = spark.read.parquet(meta).head()
        if stored_ is not None and (stored_["content_hash"], stored_["signature"], stored_["version"]) == (content_hash, SIGNATURE, version):
            return False
    delete(spark, meta)
    stats = _tokens(chunks).select((F.size("a") + F.size("b")).alias("dl")).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("words")).first()
    # dealt by block before the words are rows, so that neither postings nor blocks are shuffled
    block = F.shiftright("chunk_id", BITS).alias("block")
    dealt = chunks.select("*", block).repartition(max(1, -(-(stats["words"] or 0) // EACH)), "block")
    p = _postings(_tagged(dealt, keep=("block",)), "block")
    at = (F.col("chunk_id") - F.shiftleft("block", BITS)).cast("smallint")
    b = p.groupBy("word", "block").agg(F.count("*").cast("int").alias("n"), F.max(_part(F.lit(stats["avgdl"]))).alias("best"), F.array_sort(F.collect_list(F.struct(at.alias("at"), "f", "dl"))).alias("e"))
    b = b.select("word", "block", "n", "best", F.col("e.at").alias("at"), F.col("e.f").alias("f"), F.col("e.dl").alias("dl"))
    b.sortWithinPartitions("word", "block").write.mode("overwrite").parquet(f"{path}/postings")
    row = spark.createDataFrame([(stats["n_chunks"], stats["avgdl"], content_hash, SIGNATURE, version)], "n_chunks long, avgdl double, content_hash string, signature string, version string")
    row.write.mode("overwrite").parquet(meta)
    return True


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks of postings, one row of n_chunks and avgdl) of a stored index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/meta").select("n_chunks", "avgdl")


def unpacked(blocks: DataFrame, *keep: str) -> DataFrame:
    """(keep, word, chunk_id, f, dl): a row for each posting."""
    e = blocks.select(*keep, "word", "block", F.explode(F.arrays_zip("at", "f", "dl")).alias("e"))
    return e.select(*keep, "word", (F.shiftleft("block", BITS) + F.col("e.at")).alias("chunk_id"), "e.f", "e.dl")


def _asked(variants: DataFrame) -> tuple[DataFrame, list[str], bool]:
    """The distinct words of the variants; as constants if they are few: a question's own; a batch of questions is joined instead."""
    asked = variants.distinct()
    words = [r[0] for r in asked.select("word").distinct().limit(WORDS + 1).collect()]
    return asked, words, len(words) <= WORDS


def block_bounds(blocks: DataFrame, stats: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((variant, block, bound), (word, idf)): blocks that hold all words of a variant, with what a score there can't exceed. Postings aren't read."""
    asked, words, few = _asked(variants)
    hint = F.broadcast if few else (lambda x: x)
    heads = blocks.select("word", "block", "n", "best")
    heads = heads.where(F.col("word").isin(words)) if few else heads.join(asked.select("word").distinct(), "word", "left_semi")
    idf = stored(heads.groupBy("word").agg(F.sum("n").alias("df")).join(F.broadcast(stats)).select("word", _idf(F.col("n_chunks"), F.col("df")).alias("idf")), "idf")
    need = asked.groupBy("variant").agg(F.count("*").alias("need"))
    met = heads.join(hint(idf), "word").join(hint(asked), "word").groupBy("variant", "block").agg(F.sum(F.col("idf") * F.col("best")).alias("bound"), F.count("*").alias("hits"))
    return met.join(hint(need), "variant").where("hits = need").select("variant", "block", "bound"), idf


def block_max_top_k(spark: SparkSession, index: str, variants: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """(variant, chunk_id, score, r): the k best of each variant, as `top_k(bm25(...))`, from a stored index; `allowed` (chunk_id) limits the candidates.

    A variant's blocks of the highest bounds are read first. Its k-th best score there is a limit: of the other blocks only
    those are read whose bound reaches it.
    """
    blocks, stats = read_index(spark, index)
    asked, words, few = _asked(variants)
    hint = F.broadcast if few else (lambda x: x)
    bounds, idf = block_bounds(blocks, stats, variants)
    bounds = stored(bounds, "bounds")
    need = asked.groupBy("variant").agg(F.count("*").alias("need"))
    postings_ = blocks.where(F.col("word").isin(words)) if few else blocks

    def scored(some: DataFrame) -> DataFrame:
        own = postings_.join(small(some.join(hint(asked), "variant").select("variant", "word", "block")), ["word", "block"])
        rows = unpacked(own, "variant")
        rows = rows if allowed is None else rows.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        s = rows.join(hint(idf), "word").join(F.broadcast(stats)).groupBy("variant", "chunk_id").agg((-F.sum(F.col("idf") * _part(F.col("avgdl")))).alias("score"), F.count("*").alias("hits"))
        return s.join(hint(need), "variant").where("hits = need").select("variant", "chunk_id", "score")

    best = Window.partitionBy("variant").orderBy(F.desc("bound"), "block")
    first = stored(bounds.withColumn("o", F.row_number().over(best)).where(F.col("o") <= FIRST).drop("o"), "first")
    found = stored(top_k(scored(first), k), "found")
    limit = found.where(F.col("r") == k).select("variant", (-F.col("score") * (1 - 1e-9)).alias("limit"))
    rest = bounds.join(hint(limit), "variant", "left").where(F.col("limit").isNull() | (F.col("bound") >= F.col("limit"))).join(small(first.select("variant", "block")), ["variant", "block"], "left_anti")
    return top_k(found.drop("r").unionByName(scored(stored(rest.select("variant", "block"), "rest"))), k)


def bm25(chunks: DataFrame, variants: DataFrame, scope: Column | None = None, index: str | None = None) -> DataFrame:
    """(variant, chunk_id, score): chunks with all words of a variant; lower is better.

    `variants` is (variant, word). Document frequencies and lengths are those of all chunks; `scope` is
    applied to the candidates afterwards, so Catalyst can't move it below the statistics. From an `index` the
    words' blocks are read; else the texts are cut into words once, and what a query needs of them is stored.
    """
    asked, words, few = _asked(variants)
    if index is not None:
        found, stats = read_index(chunks.sparkSession, index)
        found = unpacked(found.where(F.col("word").isin(words)) if few else found.join(asked.select("word").distinct(), "word", "left_semi"))
    else:
        tagged = stored(_tagged(chunks, words if few else None), "tagged")
        found, stats = _postings(tagged), tagged.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))
        found = found if few else found.join(asked.select("word").distinct(), "word", "left_semi")
    df = found.groupBy("word").agg(F.count("*").alias("df"))
    need = asked.groupBy("variant").agg(F.count("*").alias("need"))
    hint = F.broadcast if few else (lambda x: x)
    s = found.join(hint(df), "word").join(F.broadcast(stats)).join(hint(asked), "word")
    if scope is not None:
        s = s.join(chunks.where(scope).select("chunk_id"), "chunk_id", "left_semi")
    s = s.groupBy("variant", "chunk_id").agg((-F.sum(_idf(F.col("n_chunks"), F.col("df")) * _part(F.col("avgdl")))).alias("score"), F.count("*").alias("hits"))
    return s.join(hint(need), "variant").where("hits = need").select("variant", "chunk_id", "score")


def top_k(ranked: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(variant, chunk_id, score, r): the k best of each variant."""
    w = Window.partitionBy("variant").orderBy("score", "chunk_id")
    return ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def fuse(ranked: DataFrame, coverage: DataFrame | None = None, k: int = CANDIDATES) -> DataFrame:
    """(chunk_id, fused): reciprocal ranks summed over the lists of (variant, chunk_id, r), plus coverage."""
    f = ranked.where(F.col("r") <= k).groupBy("chunk_id").agg(F.sum(1.0 / (RRF_K + F.col("r"))).alias("fused"))
    if coverage is None:
        return f
    return f.join(coverage, "chunk_id", "left").select("chunk_id", (F.col("fused") + ALPHA * F.coalesce("coverage", F.lit(0.0))).alias("fused"))


def dense_top_k(vectors: DataFrame, query: Column, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """(id, score): nearest by inner product in double precision, ties to the smaller id. An empty `allowed` allows none."""
    v = vectors if allowed is None else vectors.join(allowed, "id", "left_semi")
    dot = F.aggregate(F.zip_with("embedding", query, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return v.select("id", dot.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, rank, side): all chunks before (0) and after (1) a hit in its section that are no hits, by their first hit.

    `hits` is (chunk_id, rank), `chunks` (chunk_id, doc, pos, section).
    """
    c = chunks.select("chunk_id", "doc", "pos", "section")
    h = hits.join(c, "chunk_id")
    near = h.select("doc", "section", "rank", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("pos") - 1).alias("at")), F.struct(F.lit(1).alias("side"), (F.col("pos") + 1).alias("at")))).alias("x"))
    n, t = near.alias("n"), c.alias("c")
    found = n.join(t, F.expr("n.doc = c.doc and n.x.at = c.pos and n.section <=> c.section")).select(F.col("c.chunk_id").alias("chunk_id"), F.col("n.rank").alias("rank"), F.col("n.x.side").alias("side"))
    found = found.join(hits.select("chunk_id"), "chunk_id", "left_anti")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("chunk_id").orderBy("rank", "side"))).where("k = 1").select("chunk_id", "rank", "side")


def with_neighbours(hits: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Hits (chunk_id, rank) followed by the chunks before and after each in its section, until `limit` rows.

    `chunks` is (chunk_id, doc, pos, section). Order: hits by rank, then neighbours by their hit's rank, the one before first.
    """
    first = neighbours(hits, chunks).select("chunk_id", F.lit(1).alias("kind"), "rank", "side")
    every = hits.select("chunk_id", F.lit(0).alias("kind"), "rank", F.lit(0).alias("side")).unionByName(first)
    # few rows by now: top_k hits and two neighbours each
    return every.orderBy("kind", "rank", "side").limit(limit).select("chunk_id", (F.col("kind") == 0).alias("is_hit"), F.row_number().over(Window.orderBy("kind", "rank", "side")).alias("place"))


def phrase_then_terms(rows: DataFrame, text: str, asked: str) -> DataFrame:
    """Rows with the phrase; only if the whole list has none, rows with all its words (two or more)."""
    import re

    phrase = re.sub(r"\s+", " ", asked.strip().lower())
    if not phrase:
        return rows
    folded = T.squeeze(F.lower(text))
    hits = rows.where(F.contains(folded, F.lit(phrase)))
    terms = phrase.split(" ")
    if len(terms) < 2:
        return hits
    every = F.lit(True)
    for t in terms:
        every = every & F.contains(folded, F.lit(t))
    none = hits.agg((F.count("*") == 0).alias("none"))
    return hits.unionByName(rows.where(every).join(F.broadcast(none.where("none").select(F.lit(1).alias("__one"))), F.lit(1) == F.col("__one")).drop("__one"))


def retrieve(chunks: DataFrame, variants: DataFrame, question: str, scope: Column | None = None, k: int = 8, most: int | None = None, index: str | None = None) -> DataFrame:
    """The whole retrieval: ranked variants, fusion with coverage, the k best, their neighbours; with an `index` the lists come from its blocks.

    `chunks` is (chunk_id, doc, pos, section, title, text); `variants` (variant, word).
    """
    ranked = top_k(bm25(chunks, variants, scope)) if index is None else block_max_top_k(chunks.sparkSession, index, variants, allowed=None if scope is None else chunks.where(scope))
    ranked = stored(ranked, "lists")
    cand = chunks.join(ranked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    cover = cand.select("chunk_id", T.coverage(F.lit(question), F.col("text")).alias("coverage"))
    hits = fuse(ranked, cover).orderBy(F.desc(F.round("fused", 9)), "chunk_id").limit(k)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("fused", 9)), "chunk_id")))
    within = chunks if scope is None else chunks.where(scope)
    placed = with_neighbours(hits.select("chunk_id", "rank"), within, most or 3 * k)
    return placed.join(hits, "chunk_id", "left").select("chunk_id", "is_hit", "place", F.round("fused", 6).alias("fused"))
