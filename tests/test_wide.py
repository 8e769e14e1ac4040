"""Sizes and shapes that caps, copies and quadratic plans would get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators import answers, budgets, folds, linking, search, shared, structure


def test_outline_of_any_depth(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None, i) for i in range(41)] + [("x", "y", 0), ("y", "x", 1), ("z", "x", 2), ("lost", "nobody", 7)]
    got = {r["section"]: (r["depth"], r["path"]) for r in structure.outline(spark.createDataFrame(rows, "section string, parent string, ord int")).collect()}
    assert got == {f"s{i}": (i, list(range(i + 1))) for i in range(41)} | {"lost": (0, [7])}


def test_affected_by_any_number_of_terms(spark):
    terms = [f"term{i}" for i in range(300)] + ["two words", "naïve", "网络", "C++", "-net"]
    texts = [(i, f"a {t}{'s' if i % 3 == 0 and t[-1].isalpha() and t.isascii() else ''} here") for i, t in enumerate(terms)]
    texts += [(900, "xterm7 term7x"), (901, "TERM8, twoxwords"), (902, "深度网络训练"), (903, None), (904, "")]
    t = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"] for r in linking.affected(t, spark.createDataFrame([(x,) for x in terms], "source string"), ["id"]).collect()}
    assert got == set(range(len(terms))) | {901, 902}


@pytest.mark.parametrize("bound", [0, 100])
def test_needles_with_and_without_inner_words(spark, bound, monkeypatch):
    monkeypatch.setattr(linking, "BOUND", bound)
    hay = [(1, "the quick brown fox jumps over it"), (2, "unquickly brownish foxes"), (3, None), (4, "quickly brown foxes")]
    needles = [(1, "quick brown fox"), (2, "quickly brown"), (3, "k brown f"), (4, "no such words here"), (5, "short"), (6, "uick brow")]
    got = linking.contained_in(spark.createDataFrame(needles, "n int, text string"), "n", spark.createDataFrame(hay, "h int, text string"), "h")
    assert {(r["n"], r["h"]) for r in got.collect()} == {(n, h) for n, a in needles if len(a) >= 8 for h, b in hay if b and a in b}


def test_titles_by_their_rarest_words(spark):
    rng = random.Random(4)
    word = lambda: f"word{rng.randrange(30)}"
    titles = [(i, " ".join(word() for _ in range(rng.randrange(1, 8)))) for i in range(60)] + [(99, ""), (98, "a b")]
    entries = [(i, " ".join(word() for _ in range(rng.randrange(2, 12)))) for i in range(80)]
    want = {}
    for k, t in titles:
        w = [x for x in t.split() if len(x) > 2]
        found = [(-sum(x in e.split() for x in w) / len(w), i) for i, e in entries] if w else []
        if found and min(found)[0] <= -0.6:
            want[k] = (min(found)[1], -min(found)[0])
    got = linking.best_titles(spark.createDataFrame(titles, "key int, title string"), spark.createDataFrame(entries, "entry int, text string"))
    assert {r["key"]: (r["entry"], r["share"]) for r in got.collect()} == want


def test_folds_walk_long_documents(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit("one").alias("doc"), F.col("id").cast("int").alias("pos"), (F.col("id") % 7 * 100).cast("int").alias("chars")).unionByName(spark.createDataFrame([(None, 0, 5), ("two", 3, 9)], "doc string, pos int, chars int"))
    got = budgets.greedy_batches(rows).collect()
    assert len(got) == n + 2 and sum(r["batch"] == 1 for r in got if r["doc"] == "one") == 3 and max(r["batch"] for r in got) > n // 20
    assert folds.fold(rows.where("false"), "doc", ["pos"], ["chars"], dict, lambda s, c: c, "x", "int").count() == 0


def test_nearest_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(d, i, i // 4 + 1, rng.choice(["f", "p", "o"])) for d in range(20) for i in range(rng.randrange(1, 30))]
    t = spark.createDataFrame(rows, "doc int, pos int, page int, kind string")
    want = {}
    for d, i, pg, k in rows:
        others = [(abs(b[2] - pg), abs(b[1] - i), b[1]) for b in rows if b[0] == d and b[3] == "p"]
        if k == "f" and others:
            want[d, i] = min(others)[2]
    got = structure.nearest_in_order(t.where("kind = 'f'"), t.where("kind = 'p'")).collect()
    assert {(r["doc"], r["pos"]): r["nearest"] for r in got} == want


def test_places_of_a_total_order(spark):
    rows = [(i, i % 5) for i in range(1000)]
    got = shared.placed(spark.createDataFrame(rows, "id int, k int").repartition(7), [F.desc("k"), F.col("id")]).collect()
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r["id"]: r["place"] for r in got} == want
    assert shared.placed(spark.createDataFrame([], "id int"), [F.col("id")]).count() == 0


def test_index_is_built_when_stale(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "A title", "some words and more words"), (2, None, "words")], "chunk_id int, title string, text string")
    path = f"file://{tmp_path}/index"
    built = [search.ensure_index(spark, path, chunks, h, v, f) for h, v, f in (("a", "1", False), ("a", "1", False), ("b", "1", False), ("b", "2", False), ("b", "2", True))]
    assert built == [True, False, True, True, True]
    v = spark.createDataFrame([("x", "words"), ("y", "title"), ("y", "some"), ("z", "absent")], "variant string, word string")
    rows = lambda df: sorted((r["variant"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(search.bm25(chunks, v)) == rows(search.bm25(chunks, v, index=path)) != []


def test_batches_of_questions_are_joined(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, f"t{i}", f"word{i} common") for i in range(30)], "chunk_id int, title string, text string")
    v = spark.createDataFrame([(f"q{i}", f"word{i}") for i in range(30)], "variant string, word string")
    before = sorted(map(tuple, search.bm25(chunks, v).collect()))
    monkeypatch.setattr(search, "WORDS", 3)
    assert sorted(map(tuple, search.bm25(chunks, v).collect())) == before and len(before) == 30


def test_answers_abstain_without_evidence(spark):
    chunks = spark.createDataFrame([(1, 0, 0, "s", "t", "words of the paper")], "chunk_id int, doc int, pos int, section string, title string, text string")
    v = spark.createDataFrame([("raw", "absent")], "variant string, word string")
    (r,) = answers.answer(spark, chunks, v, "what?", answers.cite_first).collect()
    assert (r["status"], r["code"], r["rewritten"]) == ("insufficient_evidence", "NO_EVIDENCE", False)
    (r,) = answers.answer(spark, chunks, v, "what?", answers.cite_first, rewrite=lambda q: [("two", "words")]).collect()
    assert (r["status"], r["code"], r["evidence"], r["rewritten"]) == ("answered", "OK", [1], True)
    (r,) = answers.answer(spark, chunks, spark.createDataFrame([("raw", "paper")], v.schema), "what?", lambda p: "{}").collect()
    assert (r["status"], r["code"], r["answer"]) == ("insufficient_evidence", "UNGROUNDED_OUTPUT", "")
