"""Inputs that once were limits: many equal neighbours, rows without words, pages in a form, streams without a common cut."""

import random

import numpy as np
from pyspark.sql import functions as F

from stackroom.llm import bpe, chat, htmltext, jaccard, linededup, packing

PROSE = "This is the text of a page and it goes on for long enough that the rules for blocks know it as text of the page, with all the words of the language in it."


def test_equal_lines_beside_a_repeated_chunk_all_go(spark):
    rng = random.Random(2)
    shared = [" ".join(f"w{rng.randrange(9000)}" for _ in range(9)) for _ in range(40)]
    for filler in ("equal line", "another equal line", "x"):
        rows = [(i, "\n".join([filler] * 200 + shared + [f"own end {i}"])) for i in range(3)]
        got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
        first_chunk = linededup.cut(rows[0][1].encode().split(b"\n"))[0][1]
        least = 230 if first_chunk > 1 else 30
        assert got[0]["n_removed"] == 0 and all(least <= got[i]["n_removed"] <= 240 for i in (1, 2)), filler


def test_classes_beyond_the_bound_are_shuffled(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted((r["doc_id"], r["th"], tuple(map(tuple, r["gone"]))) for r in linededup.removals(docs).collect())
    want = rows()
    monkeypatch.setattr(linededup, "BESIDE", 0)
    assert rows() == want and want


def test_rows_without_words_stay_whatever_else_there_is(spark):
    a = "one two three four five six seven eight"
    rows = [(1, a), (9, ""), (9, ""), (None, None), (None, None), (7, " \n"), (7, " \n")]
    for more in ([], [(1, a)], [(1, a), (2, a)]):
        got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()), key=str)
        assert got == sorted(rows, key=str)


def test_pages_in_a_form():
    for page in (f"<form><div>{PROSE}</div><p>{PROSE}</p></form>", f"<form><article>{PROSE}<p>{PROSE}</article></form>", f"<body><form id='aspnetForm'><div class='nav'>Home</div><p>{PROSE}</p><p>{PROSE}</p><div class='cookie-notice'>{PROSE}</div></form></body>"):
        assert htmltext.main_text(page) == f"{PROSE}\n{PROSE}", page
    assert htmltext.main_text(f"<p>{PROSE}</p><p>{PROSE}</p><form class='search'><label>Find it here</label> {PROSE}</form>") == f"{PROSE}\n{PROSE}"
    assert htmltext.main_text(f"<article><p>{PROSE}</p><form>Your name <input> Your text</form></article>") == PROSE


def test_packing_goes_on_until_a_cut_is_shared():
    class None_:
        def ends(self, ids):
            return np.zeros(len(ids), bool)

    packer, got = packing.Packer(None_(), 16, 8), []
    for i in range(60):
        got += packer.add(i, np.arange(i % 5 + 1, dtype=np.uint32))
    got += packer.finish()
    ends = np.cumsum([i % 5 + 1 for i in range(60)])
    ids = np.zeros(int(ends[-1]), np.uint32)
    want = packing.best_cuts(*packing.boundaries(ids, ends, None_(), 16), 16)
    size = {}
    for _, _, b, _, s, _ in got:
        size[s] = size.get(s, 0) + len(b) // 4
    assert np.cumsum([size[s] for s in sorted(size)]).tolist() == want


def test_forms_of_the_tables_change_nothing(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert htmltext.extract(pages).where(F.length("text") == 0).count() == 0


def test_windows_of_real_tokens(spark):
    path = bpe.default_path("byte_bpe_multi_50k.tiktoken")
    tok = bpe.made(path)[0]
    rows = [(1, 0, "system", "be brief")] + [(1, i, ("user", "assistant")[i % 2 == 0], "word " * (7 * i % 90) + "</s> é") for i in range(1, 60)]
    w = sorted(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 300, 80, path).collect(), key=lambda r: r["window"])
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for r in w:
        pieces = [x + "</s>" for x in r["formatted"].split("</s>")[:-1]]
        assert r["n_tokens"] == sum(map(count, pieces)) and r["n_tokens"] <= 300 and len(pieces) == r["n_turns"]
    targets = [chat.unescape(r["formatted"][s["start"] : s["start"] + s["length"]]) for r in w for s in r["loss"]]
    assert targets == [t for _, _, role, t in rows if role == "assistant"] and len(w) > 5
