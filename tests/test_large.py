"""Steps that must stay within bounds, and give the same rows, on tables that are larger than the smallest ones."""

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from stackroom.functions import spans
from stackroom.functions import text as T
from stackroom.operators import linking, search, selection, structure
from stackroom.plans import catalog


@pytest.fixture
def parts(spark, tmp_path):
    """Writes a table of so many parts, and gives its folder."""

    def write(n: int, first: int = 0) -> str:
        spark.range(first, first + n).selectExpr("id p_partkey", "concat('name ', id % 97) p_name", "'Brand#1' p_brand", "'SMALL' p_type", "cast(id % 2 as int) p_size", "1.0D p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return write


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_beside_a_part_of_the_same_number(spark, parts):
    got = sorted(tuple(r) for r in catalog.QUERIES["k13_upsert"](spark, parts(2, 999_998)).collect())
    assert got == [(999_998, f"name {999_998 % 97}"), (999_999, f"name {999_999 % 97}"), (999_999, "new")]


def test_hierarchy_broadcasts_no_rows(spark, parts):
    assert "Broadcast" not in plan(catalog.QUERIES["e04_hierarchy"](spark, parts(50)))


def test_quotes_of_large_pages_meet_by_words(spark, monkeypatch):
    r = random.Random(3)
    words = ["a", "ab", "abc", "#12.", "#123.", "é𝒳é", "longerword", "x" * 20]
    texts = [" ".join(r.choices(words, k=r.randint(0, 6))) for _ in range(80)]
    quotes = [t[i : i + r.randint(1, 30)] for t in texts for i in (0, 1, 3)] + ["", "none of them", "x" * 17, texts[0] + " ab " + texts[1]]
    p = spark.createDataFrame([(i, f"a{i}", i % 2, 1, t) for i, t in enumerate(texts)], "id long, anchor string, doc int, page int, text string")
    t = spark.createDataFrame([(i, "no", i % 2, 1, q) for i, q in enumerate(quotes)], "target long, anchor string, doc int, page int, quote string")
    got = {}
    for few in (0, 1000):
        monkeypatch.setattr(structure, "FEW", few)
        got[few] = sorted(tuple(x) for x in structure.reattach(t, p).collect())
    assert got[0] == got[1000] and len({x[1] for x in got[0]}) == 3


def test_unit_cut_before_a_word_keeps_its_space(spark):
    unit = "one two three four five six seven eight nine ten "
    p = spark.createDataFrame([(1, 1, unit + "eleven"), (1, 2, "and " + unit.strip())], "doc int, paragraph int, text string")
    u = spark.createDataFrame([(1, 9, unit)], "doc int, unit int, text string")
    found = lambda **how: [(r["paragraph"], r["cause"]) for r in linking.map_units(u, p, **how).collect()]
    assert found(normalized=True) == [(1, None)] and found() == [(None, "DUPLICATE_SOURCE_TEXT")]


SF = "/root/testdata/sf0.001"


def test_columns_count_changes_not_cells(spark):
    # rows of cells would be a hundred for each block
    for name in ("f05_reading_order", "f06_column_split", "f07_columns_in_bands"):
        assert "sequence(" not in plan(catalog.QUERIES[name](spark, SF))


def test_words_of_a_document_are_dealt_once(spark):
    assert plan(catalog.QUERIES["h35_inverted_abstract"](spark, SF)).count("Exchange") == 1


def test_sketches_are_of_types_alone(spark):
    lines = plan(catalog.QUERIES["l_approx_distinct"](spark, SF)).splitlines()
    assert any("approx_count_distinct" in x for x in lines) and not any("approx_count_distinct" in x and re.search(r"keys=\[[^\]]*user_id", x) for x in lines)


def test_index_stores_nothing_but_itself(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(search, "stored", never)
    monkeypatch.setattr(search, "EACH", 50)
    chunks = spark.createDataFrame([(i, "t", f"word{i % 7} common" * (i % 5)) for i in range(-9, 3000)], "chunk_id long, title string, text string")
    path = f"file://{tmp_path}/index"
    assert search.ensure_index(spark, path, chunks, "h", "1")
    got = search.unpacked(search.read_index(spark, path)[0]).select("chunk_id", "dl", "word", "f")
    want = search.postings(chunks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_trigrams_walk_a_text_once(spark):
    assert "substring(" not in plan(catalog.QUERIES["h46_text_supports"](spark, SF))
    t = spark.createDataFrame([("one two three four five six 𝒳é𝒳", "ne tw hree our ive si é𝒳"), ("ab", "abc"), ("one two three four five six", "zzzz yyyy")], "a string, b string")
    assert [r[0] for r in t.select(T.text_supports(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_units_of_small_documents_are_dealt_once(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "beta", "gamma", "an", "é𝒳é", "longerword", "x" * 9])
    paras = [(d, i, " ".join(word() for _ in range(r.randint(0, 14)))) for d in range(4) for i in range(40)] + [(4, 0, "")]
    units = [(d, i, r.choice([t, t[: len(t) * 9 // 10], t + " more", t.replace("alpha", "omega"), "{v1} " + t])) for d, i, t in paras] + [(9, 1, "a unit of a document that has no paragraphs"), (9, 2, None)]
    u, p = spark.createDataFrame(units, "doc int, unit int, text string"), spark.createDataFrame(paras, "doc int, paragraph int, text string")
    found = lambda: sorted((x["doc"], x["unit"], x["paragraph"] or -1, x["cause"] or "") for x in linking.map_units(u, p).collect())
    whole = found()
    monkeypatch.setattr(linking, "FEW", 0)
    assert found() == whole and len({x[3] for x in whole}) == 5 and len(whole) == len(units)
    monkeypatch.undo()
    lines = plan(linking.map_units(u, p)).splitlines()
    assert sum("Exchange" in x for x in lines) == 1 and not any("Join" in x for x in lines)


def test_spans_are_not_walked_by_character():
    def calls(tree) -> int:
        seen = []
        sys.setprofile(lambda _, event, __: seen.append(event))
        try:
            spans.joined(tree)
        finally:
            sys.setprofile(None)
        return len(seen)

    tree = lambda n: [{"type": "text", "content": "word  \t" * n, "styles": ["bold"]}, {"type": "equation_inline", "content": "x" * n}]
    assert calls(tree(1000)) == calls(tree(2))


def test_parser_json_is_read_from_one_table(spark):
    # its texts were made again for each of the branches of both dialects
    assert "documents.parquet" not in plan(catalog.QUERIES["a05_flatten_legacy"](spark, SF))


def test_ancestors_broadcast_no_rows(spark, parts, monkeypatch):
    seen, stored = [], structure.stored
    monkeypatch.setattr(structure, "stored", lambda df, name: (seen.append(plan(df)), stored(df, name))[1])
    assert catalog.QUERIES["f15_ancestors"](spark, parts(20)).count() > 20
    assert len(seen) > 3 and not any("Broadcast" in x for x in seen)


def test_tokens_are_found_by_one_pattern(spark):
    assert "regexp_replace" not in plan(catalog.QUERIES["h11_content_terms"](spark, SF))
    r = random.Random(7)
    odd = ["".join(r.choices("aB7_-.é ß'Σ𝒳İ́\n漢", k=r.randint(0, 14))) for _ in range(3000)] + ["", None]
    old = F.filter(F.transform(F.split("s", T.WORD_SPLIT), lambda w: F.lower(F.regexp_replace(w, T.EDGES, ""))), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    t = spark.createDataFrame([(x,) for x in odd], "s string")
    assert t.where(~old.eqNullSafe(T.tokens(F.col("s")))).count() == 0


def test_rows_of_much_work_are_dealt(spark):
    for name in ("a06_archives", "h52_joined_styles"):
        assert "RoundRobinPartitioning" in plan(catalog.QUERIES[name](spark, SF))


def test_folding_takes_one_worker(spark):
    assert plan(catalog.QUERIES["h17_normalize_for_matching"](spark, SF)).count("+- ArrowEvalPython") == 1


def test_boxes_of_short_pages_need_no_table_of_conflicts(spark, duck, monkeypatch):
    def none(*_):
        raise AssertionError("pages of a few boxes are walked")

    monkeypatch.setattr(selection, "conflicts", none)
    got = catalog.QUERIES["f17_drop_duplicate_boxes"](spark, "/root/testdata/sf0.001")
    assert len(re.findall(r"Exchange", plan(got))) == 1
    want = duck.sql(catalog.ORACLE_SQL["f17_drop_duplicate_boxes"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_boxes_of_long_pages_are_those_of_the_walk(spark, monkeypatch):
    r, inf, nan = random.Random(5), float("inf"), float("nan")
    edge = lambda n: round(r.randrange(n) * 0.3 - 1, 1)
    boxes = [(p, i, r.choice([0.5, 0.7, None]), edge(n), edge(n), 10 + edge(n), 10 + edge(n)) for p, n in ((1, 4), (None, 6), (2, 30)) for i in range(150)]
    boxes += [(3, 0, 0.9, -1e-17, 0.0, 9.0, 9.0), (3, 1, 0.8, 0.5, 0.0, 9.0, 9.0)]  # doubles half a point apart
    odd = [nan, inf, -inf, 1e300, -1e300, None]
    boxes += [(4, i, 0.5, odd[i % 6], 0.1 * (i // 12), 9.0, 9.0) for i in range(48)] + boxes[:20]
    want, plain = [], lambda b: all(v is not None and abs(v) < inf for v in b)
    for p in (1, None, 2, 3, 4):
        kept = []
        for b in sorted({str(b): b for b in boxes if b[0] == p}.values(), key=lambda b: (inf if b[2] is None else -b[2], b[1])):
            e = b[3:]
            if not any(str(e) == str(k) or plain(e) and plain(k) and all(abs(x - y) <= 0.5 for x, y in zip(e, k, strict=True)) for k in kept):
                kept.append(e)
                want.append((str(p), b[1]))
    t = spark.createDataFrame([(*b, f"n{b[1]}") for b in boxes], "page int, id int, score double, x0 double, y0 double, x1 double, y1 double, note string")
    for walked, few in ((100_000, 16), (100_000, 0), (160, 16), (0, 16)):
        monkeypatch.setattr(selection, "WALKED", walked)
        monkeypatch.setattr(selection, "FEW", few)
        got = selection.drop_duplicates(t).collect()
        assert sorted((str(b["page"]), b["id"]) for b in got) == sorted(want) and all(b["note"] == f"n{b['id']}" for b in got)
