"""The methods against brute force, exact round trips and held-out accuracy."""

import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from stackroom.llm import ann, bpe, chat, common, htmltext, jaccard, licenses, linededup, lm, packing, quality

SF = "/root/testdata/sf0.001"


def words(rng, n, k=400):
    return [f"v{rng.randrange(k)}" for _ in range(n)]


# 1: license scans


@pytest.mark.parametrize(
    ("notice", "labels"),
    [
        ("Licensed under CC BY 4.0.", {"cc-by-4.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("licensed under CC-BY-SA-4.0", {"cc-by-sa-4.0"}),
        ("Licensed under CC BY-ND 4.0.", {"cc-by-nd-4.0"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"cc-by-nc-sa-4.0"}),
        ("Licensed under CC BY-NC-ND 4.0.", {"cc-by-nc-nd-4.0"}),
        ("Licensed under CC BY-NC 4.0. And this is licensed under CC BY-SA 4.0.", {"cc-by-nc-4.0", "cc-by-sa-4.0"}),
        ("This work is licensed under the GNU General Public License version 2.", {"gpl-2.0"}),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("Released under the MIT license. All rights reserved.", {"mit"}),
        ("This is free and unencumbered software released into the public domain", {"unlicense"}),
    ],
)
def test_rival_licenses(spark, notice, labels):
    row = licenses.scan(spark.createDataFrame([(1, f"some words before it. {notice} and some behind"), (2, notice + " x" * 300 + " " + notice)], "doc_id long, text string")).collect()
    assert [{m["label"] for m in r["matches"]} for r in row] == [labels] * 2


@pytest.mark.parametrize("stem", ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or at your option any later version"])
def test_rival_versions(spark, stem):
    for v in "23":
        (row,) = licenses.scan(spark.createDataFrame([(1, stem.format(v))], "doc_id long, text string")).collect()
        assert {m["label"] for m in row["matches"]} == {f"gpl-{v}.0-or-later"}


# 2: n-gram Jaccard join


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("small", "hot"), [(4, 50_000), (40, 10)])
def test_near_copies_in_large_groups(spark, small, hot, monkeypatch):
    """A base edited more and more: many links hang on single pairs; groups larger than SMALL and pieces of few members."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PIECE", 30)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(small)
    docs, base = [], words(rng, 120)
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(words(rng, 60) + base[:40])) for i in range(60)]  # a passage that many share
    docs += [(300 + i, docs[i][1]) for i in range(10)] + [(400, None), (401, ""), (402, "one two"), (403, "ONE  two")]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


def test_fragments_cut_the_whole_order():
    o = jaccard.Order(np.arange(10, 60, dtype=np.uint64), np.arange(50, dtype=np.int64))
    s = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    s = np.unique(np.concatenate([s, np.arange(10, 60, dtype=np.uint64) << np.uint64(24)]))
    f = o.fragment(s)
    assert f.min() == 0 and f.max() == jaccard.FRAGMENTS - 1
    assert (o.common(o.sort(s))[-50:] == np.arange(50)).all()


def test_words_are_those_of_split(monkeypatch):
    monkeypatch.setattr(common, "STEP_BYTES", 50)
    rng, seen = random.Random(1), {}
    for k in range(200):
        texts = [None, "", *["".join(rng.choice(["a", "B", " ", "\n", "é", "x" * 40, "\x85", "\t", "y" * 90]) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(9))]]
        h, n = common.word_hashes(pa.array(texts, pa.string()).slice(k % 3))
        split = [(t or "").encode().lower().split() for t in texts[k % 3 :]]
        assert n.tolist() == [len(w) for w in split]
        assert all(seen.setdefault(w, x) == x for w, x in zip((w for ws in split for w in ws), h.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) and common.word_hashes(pa.array([], pa.string()))[0].tolist() == []


@given(st.lists(st.integers(0, 12), max_size=8), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_gram_sets_are_those_of_each_text(counts, n):
    rng = np.random.default_rng(sum(counts))
    words = rng.integers(0, 4, sum(counts)).astype(np.uint64)
    got, at, seen = jaccard.gram_sets(words, np.array(counts, np.int64), n), 0, {}
    for c, g in zip(counts, got, strict=True):
        w = words[at : at + c].tolist()
        at += c
        want = {tuple(w[i : i + n]) for i in range(max(1, c - n + 1))} if c else set()
        assert len(g) == len(want) and (np.diff(g.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(want), g.tobytes()) == g.tobytes()


@pytest.mark.parametrize("bits", [(1 << 64) - 1, (1 << 12) - 1])
def test_sets_that_share_half_a_digest(spark, bits, monkeypatch):
    monkeypatch.setattr(jaccard, "NODE_BITS", bits)
    rng = random.Random(7)
    docs = [(i, " ".join(words(rng, 40))) for i in range(150)]
    docs += [(500 + i, t + " end") for i, t in docs[:60]]
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(docs)


def test_rows_without_ids_and_repeated_ids(spark):
    rng = random.Random(8)
    base = words(rng, 80)
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(0, 80, 2)]
    d = spark.createDataFrame([(None, t) for t in near] + [(None, "alone in the world it is"), (None, None), (None, "")], "doc_id long, text string")
    got = jaccard.classes(d).collect()
    assert len({r["one"] for r in got if r["n"] > 5}) == 1 and all(r["component_id"] is None for r in jaccard.near_duplicates(d).collect())
    assert sorted(str(r["text"]) for r in jaccard.keep_one(d).collect())[:2] == ["", "None"] and jaccard.keep_one(d).count() == 4
    # an id that several texts have: only the row that belongs to a group goes
    d = spark.createDataFrame([(1, near[0]), (2, near[1]), (2, "a text of its own that nobody else has"), (None, near[2]), (3, "same words here"), (3, "same words here")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"][:4]) for r in jaccard.keep_one(d).collect()) == [(1, near[0][:4]), (2, "a te"), (3, "same")]


# 3: chats


@given(st.text(alphabet="<>[]/\\sINST|SY_a\n", max_size=60), st.text(alphabet="<>[/\\sn\n", max_size=20))
@settings(max_examples=400, deadline=None)
def test_escape_round_trip(text, role):
    out = chat.escape(text)
    assert chat.unescape(out) == text and "</s>" not in out and "[INST]" not in out and "<s>" not in out
    assert chat.read_role(chat.write_role(role)) == role and "\n" not in chat.write_role(role)


def test_windows_fit_and_repeat_masked(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 9 + 1) * 8) for i in range(1, 60)]
    w = sorted(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r["window"])
    assert len(w) > 3 and all(r["n_tokens"] <= chat.BUDGET for r in w)
    assert all(r["formatted"].startswith("<s>system\nbe kind</s>") for r in w) and all(r["n_repeated"] > 1 for r in w[1:])
    targets = [r["formatted"][s["start"] : s["start"] + s["length"]] for r in w for s in r["loss"]]
    assert targets == [t for _, _, role, t in rows if role == "assistant"]


# 4: byte-level BPE


@pytest.fixture(scope="module")
def both():
    import public_tokenizers
    import tiktoken

    path = bpe.default_path("byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}), bpe.UnitEncoder(bpe.made(path)[0], 1000), bpe.made(path)[1]


def test_bpe_is_that_of_tiktoken(both, duck):
    enc, unit, table = both
    rng = random.Random(3)
    texts = [r[0] for r in duck.sql("select text from documents").fetchall()]
    texts += ["".join(rng.choice("ab eE1.,'  \n\n\t éñ漢字😀̀<|>\xa0　x\r") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for i in range(0, len(texts), 50):  # a table of 1000 units forgets again and again
        for t, ids in zip(texts[i : i + 50], unit.encode(texts[i : i + 50]), strict=True):
            ids = np.frombuffer(ids, "<u4").tolist()
            assert ids == enc.encode_ordinary(t) and b"".join(table[i] for i in ids) == t.encode()


def test_units_hold_the_white_space_before_them():
    """Every mixture of white space gives the ids that the library gives for the whole text; most go by units."""
    import public_tokenizers
    import tiktoken

    path = bpe.default_path("byte_bpe_multi_50k.tiktoken")
    enc, other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={}), bpe.made(bpe.default_path("byte_bpe_50k.json"))[0]
    units, more, rng = bpe.UnitEncoder(bpe.made(path)[0], 1500), bpe.UnitEncoder(other, 1500), random.Random(5)
    alphabet = ["a", "b", " ", "  ", "E1.", ",", "'s", "'", "\n", "\n\n", "\t", "é", "漢字", "😀", "\u0300", "<|", "\xa0", "\u3000", "\u2009", "\x1c", "\x85", "\r\n", "x" * 40, "\x0b", "12", "\u200b"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(6000)]
    for i in range(0, len(texts), 60):
        some = texts[i : i + 60]
        for t, x, y in zip(some, units.encode(some), more.encode(some), strict=True):
            assert np.frombuffer(x, "<u4").tolist() == enc.encode_ordinary(t)
            assert np.frombuffer(y, "<u4").tolist() == other.encode(t, add_special_tokens=False).ids
    plain = ["two  spaces", " at both ends \n", "a\n\n\tb", "no\xa0break"]
    off = np.cumsum([0, *[len(t.encode()) for t in plain]])
    assert not bpe.irregular(np.frombuffer("".join(plain).encode(), np.uint8), off).any()


def test_offsets_and_decoding_of_columns(spark, both):
    _, _, table = both
    path, texts = bpe.default_path("byte_bpe_multi_50k.tiktoken"), ["naïve 漢字 😀 end", None, "", "two  spaces\tand\u00a0more", "a\nb 漢", "<|endoftext|> é"]
    e = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1), path)
    for r in e.collect():
        t = texts[r["doc_id"]] or ""
        ids, a, b = (np.frombuffer(r[c], "<u4").tolist() for c in ("ids", "char_starts", "char_ends"))
        want = bpe.char_offsets(t.encode(), np.array([len(table[i]) for i in ids], np.int64))
        assert a == want[0].tolist() and b == want[1].tolist() and (not t or b[-1] == len(t))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(e.drop("char_starts", "char_ends"), path).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_offsets_and_split_characters(both):
    _, unit, table = both
    text = "naïve 漢字 😀 end"
    ids = np.frombuffer(unit.encode([text])[0], "<u4")
    a, b = bpe.char_offsets(text.encode(), np.array([len(table[i]) for i in ids]))
    assert a[0] == 0 and b[-1] == len(text) and all(x <= y for x, y in zip(a, a[1:]))
    for i, (x, y) in enumerate(zip(a, b)):
        assert table[ids[i]] in text[x:y].encode()
    for cut in range(len(ids) + 1):
        h1, t1, r1 = bpe.decode_span(ids[:cut].tolist(), table)
        h2, t2, r2 = bpe.decode_span(ids[cut:].tolist(), table)
        assert (h1 + t1.encode() + r1 + h2 + t2.encode() + r2).decode() == text and "�" not in t1 + t2


# 5: context-tree weighting


def brute_ctw(train, text, depth):
    """Posterior mixture along each path, from counts by node."""
    n = defaultdict(lambda: [0, 0])
    pad = bytes([255]) * depth
    for t in train:
        s = pad + t + b"\xff"
        for i in range(depth, len(s)):
            for j in range(8):
                node, bit = (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1
                for d in range(depth + 1):
                    n[(s[i - d : i], node)][bit] += 1
    lg = math.lgamma
    pe = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - math.log(math.pi) - lg(a + b + 1)
    below = defaultdict(float)
    pw = {}
    for d in range(depth, -1, -1):
        for (c, node), (a, b) in list(n.items()):
            if len(c) == d:
                e = pe(a, b)
                pw[c, node] = e if d == depth else math.log(0.5) + max(e, below[c, node]) + math.log1p(math.exp(-abs(e - below[c, node])))
                if d:
                    below[c[1:], node] += pw[c, node]
    total, s = 0.0, pad + text + b"\xff"
    for i in range(depth, len(s)):
        for j in range(8):
            node, bit = (1 << j) | (s[i] >> (8 - j)), (s[i] >> (7 - j)) & 1
            had, left, p = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                key = (s[i - d : i], node)
                if key not in n:
                    break
                a, b = n[key]
                kt = (b + 0.5) / (a + b + 1)
                p = had + left * kt
                w = 1.0 if d == depth else 1 / (1 + math.exp(min(700, below[key] - pe(a, b))))
                had, left = had + left * w * kt, left * (1 - w)
            total += math.log10(p if bit else 1 - p)
    return total


@pytest.mark.parametrize("depth", [1, 2])
def test_ctw_against_brute_force(depth):
    train = [b"abracadabra", b"", "été".encode(), b"banana band"]
    tree = lm.ContextTree(*lm.gram_counts(train, depth), depth)
    for t in [b"abra", b"", b"zebra", "été".encode()]:
        assert tree.score([t])[0] == pytest.approx(brute_ctw(train, t, depth), rel=1e-5)
    # the mixture is a distribution: the bytes after any context sum to one
    assert np.allclose((10 ** tree.log.reshape(-1, 256).astype(float)).sum(1), 1, atol=1e-4)


def test_lm_base_and_held_out_accuracy(spark, duck, monkeypatch):
    monkeypatch.setattr(lm, "HOT_MAX", 50)  # most words take the way through the shuffle
    from stackroom.llm.common import load

    got = {r["doc_id"]: r for r in lm.score(load(spark, SF, "documents")).collect()}
    docs = duck.sql("select doc_id, text from documents").fetchall()
    split = lambda t: [*t.encode().lower().split(), None]
    c = Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 10 for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        w = split(t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    bits = -sum(r["score"] for r in held) * math.log2(10) / sum(len(dict(docs)[r["doc_id"]].encode()) + 1 for r in held)
    text = b"".join(t.encode() for i, t in docs if not got[i]["held_out"])
    order0 = -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values())
    assert bits < 0.75 * order0


# 6: line dedup


def test_chunks_move_with_their_lines():
    rng = random.Random(1)
    lines = [f"line {rng.randrange(10**9)}".encode() for _ in range(60)]
    a = {b"\n".join(lines[s : s + n]) for s, n in linededup.cut(lines)}
    moved = [b"new", *lines[:30], b"inserted", *lines[31:]]
    b = {b"\n".join(moved[s : s + n]) for s, n in linededup.cut(moved)}
    assert len(a & b) >= 0.7 * len(a) and b"\n".join(b"\n".join(moved[s : s + n]) for s, n in linededup.cut(moved)) == b"\n".join(moved)


def test_bytes_decide_where_hashes_meet(spark):
    from stackroom.llm.common import load

    docs = load(spark, SF, "documents")
    rows = lambda mask: sorted((r["doc_id"], r["th"], tuple(map(tuple, r["gone"]))) for r in linededup.removals(docs, mask).collect())
    assert rows(3) == rows((1 << 64) - 1) != []


# 7: HTML


PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1><p>Welcome to the site of the things</p></header><div id="cookie-banner">We use cookies <button>OK</button></div>
<nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul><main><article class="post"><header><h1>Title &amp; more</h1></header><p>First para of the <a href=x>text</a> is here &mdash; and&nbsp;it goes on with the other things that we know.
<p>Short.<div class="ad">Buy now the best</div><script>var t = "</p>";</script><ul><li>one <b>it</b>em</ul><aside>Related stuff</aside><form><label>Search the site</label></form>
<section id="comments"><h2>Comments</h2><p>I think that this is the best article of the year and so on and on for ever.</p></section></article></main><footer>&copy; the</footer>"""


def test_html_containers_and_references():
    assert htmltext.main_text(PAGE) == "Title & more\nFirst para of the text is here — and it goes on with the other things that we know.\nShort.\none item"


def test_html_without_a_marked_region():
    long = "This is the first paragraph of the story and it has a lot of words in it that are of the kind that is common."
    page = f"<div class=menu><a href=1>Home</a> | <a href=2>News</a></div><p>{long}</p><p>Yes.</p><p>{long}</p><ul><li><a href=3>a link to the rest</a></li></ul><p>Copyright ACME</p>"
    assert htmltext.main_text(page) == f"{long}\nYes.\n{long}"


def test_html_articles_of_the_tables(duck):
    import html
    import re

    for (h,) in duck.sql("select html from pages").fetchall():
        a = re.search(r"<article>(.*)</article>", h, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", a)]
        assert htmltext.main_text(h) == "\n".join(b for b in want if b)


ZH = "深度残差学习框架使得训练非常深的神经网络变得更加容易，我们提供了全面的实证证据表明这些残差网络更容易优化，并且可以从显著增加的深度中获得精度。" * 3
RU = "Это первый абзац рассказа, и в нём много слов, которые встречаются часто и повсюду, потому что он написан обычным языком без всяких затей. " * 3
IT = "Questo è il primo paragrafo della storia e contiene molte parole che sono comuni nella lingua italiana perché è stato scritto senza pretese. " * 3


@pytest.mark.parametrize("text", [ZH, RU, IT])
def test_html_pages_in_languages_without_stop_words(text):
    text = text.strip()
    page = f"<body><div class=menu><a href=1>A</a> <a href=2>B</a></div><div><p>{text}</p><p>{text}</p></div><ul><li><a href=3>{text}</a></ul><div class='page-footer'>x y z</div></body>"
    assert htmltext.main_text(page) == f"{text}\n{text}"


PARA = "This is the first paragraph of the story and it has a lot of words in it that are of the kind that is common."


def test_html_names_that_only_look_like_cues():
    article = f'<article><div class="social-history"><p>{PARA}</p></div><div class="notice-board"><p>{PARA}</p></div><h2 id="related-work">Related work</h2><p>{PARA}</p><div class="comment-list"><p>{PARA}</p></div></article>'
    assert htmltext.main_text(article) == f"{PARA}\n{PARA}\nRelated work\n{PARA}"
    # a layout container around all of the page, and one with little of it; comments are never freed
    page = f'<body class="has-sidebar"><div id="page" class="header"><p>{PARA}</p><p>{PARA}</p></div><div class="sidebar"><p>{PARA}</p></div><div id="comments">{f"<p>{PARA}</p>" * 9}</div></body>'
    assert htmltext.main_text(page) == f"{PARA}\n{PARA}"


def test_html_broken_markup_does_not_leak():
    page = f'<p class="x"">{PARA}</p><p title=\'a > b\' data-x="<i>">{PARA}</p><p><a href="foo>{PARA}</a> {PARA} {PARA}'
    assert htmltext.main_text(page.replace('"foo>', '"foo">')) == f"{PARA}\n{PARA}\n{PARA} {PARA} {PARA}"
    assert htmltext.main_text(page) == f"{PARA}\n{PARA}\n{PARA} {PARA} {PARA}"
    assert htmltext.main_text(f"<p>1 < 2 <3 <!-- x <p>no</p> --> and <![CDATA[none]]>{PARA}") == f"1 < 2 <3 and {PARA}"


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, '<a href="x' * 20_000, "<p title='" * 20_000, "<!" * 100_000, "<" * 200_000, "<li>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<nav>" * 20_000 + "<article>" * 20_000, "<a " + "x " * 100_000, "<p " + " " * 200_000])
def test_html_takes_time_in_proportion(page):
    begun = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - begun < 5


def brute_pass_two(labels, marked):
    """Open blocks by all decided ones: the nearest on either side."""
    out = []
    for i, x in enumerate(labels):
        left = [labels[j] for j in range(i) if labels[j]][-1:]
        right = [labels[j] for j in range(i + 1, len(labels)) if labels[j]][:1]
        dl = next((i - j for j in range(i - 1, -1, -1) if labels[j]), 10**9)
        dr = next((j - i for j in range(i + 1, len(labels)) if labels[j]), 10**9)
        if x:
            out.append(x == 1)
        elif marked:
            out.append(not (left + right) or len(left + right) < 2 or 1 in left + right)
        else:
            out.append(bool(left + right) and (left if dl < dr else right)[0] == 1)
    return out


@given(st.lists(st.sampled_from([1, -1, 0]), max_size=12), st.booleans())
@settings(max_examples=200, deadline=None)
def test_html_second_pass_against_brute_force(labels, marked):
    kinds = {1: f"<p>{PARA}</p>", -1: "<p><a href=x>go to the next page</a></p>", 0: "<p>Short words.</p>"}
    texts = {1: PARA, -1: "go to the next page", 0: "Short words."}
    page = "".join(kinds[x] for x in labels)
    want = "\n".join(texts[x] for x, keep in zip(labels, brute_pass_two(labels, marked), strict=True) if keep)
    assert htmltext.main_text(f"<main>{page}</main>" if marked else page) == want


# 8: packing


@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from([0, 3, 10])), min_size=1, max_size=14))
@settings(max_examples=300, deadline=None)
def test_cuts_are_optimal(steps):
    pos, pen = np.cumsum([s for s, _ in steps]), np.array([p for _, p in steps])
    cuts = packing.best_cuts(pos, pen, 12)
    at, cost = {0: 0, **{int(p): int(q) for p, q in zip(pos, pen)}}, {0: 0}
    for p in sorted(at)[1:]:
        cost[p] = min(cost[q] + 12 - (p - q) + at[p] for q in cost if p - 12 <= q < p)
    got = sum(12 - (b - a) + at[b] for a, b in zip([0, *cuts], cuts))
    assert got == cost[int(pos[-1])] and all(b - a <= 12 for a, b in zip([0, *cuts], cuts))


class Marked:
    """Token 5 ends a sentence."""

    def ends(self, ids):
        return ids == 5


@given(st.lists(st.lists(st.integers(1, 9), max_size=40), min_size=1, max_size=30), st.integers(20, 90))
@settings(max_examples=200, deadline=None)
def test_blocks_give_the_best_cuts_of_the_stream(docs, block):
    packer, pieces = packing.Packer(Marked(), 16, block), []
    docs = [np.array([*d, 0], "<u4") for d in docs]
    for i, d in enumerate(docs):
        pieces += packer.add(i, d)
    pieces += packer.finish()
    ends = np.cumsum([sum(len(p[2]) // 4 for p in pieces if p[4] == s) for s in range(packer.sequence)])
    pos, pen = packing.boundaries(np.concatenate(docs), np.cumsum([len(d) for d in docs]), Marked(), 16)
    at, cost = dict(zip([0, *pos.tolist()], [0, *pen.tolist()])), {0: 0}
    for p in sorted(at)[1:]:
        cost[p] = min(cost[q] + 16 - (p - q) + at[p] for q in cost if p - 16 <= q < p)
    assert sum(16 - (b - a) + at[b] for a, b in zip([0, *ends.tolist()], ends.tolist())) == cost[int(pos[-1])]


def test_sentence_ends():
    tok, table = bpe.made(bpe.default_path("byte_bpe_50k.json"))
    ids = np.array(tok.encode('It is 3.14, e.g. this at a.b/c. "Yes." (No!) Then\nend', add_special_tokens=False).ids)
    on, text, cuts = packing.Sentences(table).ends(ids), b"", []
    for i, x in zip(ids, on, strict=True):
        text += table[i]
        if x:
            cuts.append(text.decode())
            text = b""
    assert cuts == ["It is 3.14, e.g. this at a.b/c.", ' "Yes."', " (No!)", " Then\n"] and text == b"end"


def check_pieces(pieces, docs):
    tok = bpe.made(bpe.default_path("byte_bpe_50k.json"))[0]
    by, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == {i for i, _ in docs}
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
        used += at
    return used / 1024 / len(seqs)


def test_packing_round_trip(spark, duck):
    from stackroom.llm.common import load

    fill = check_pieces(packing.pieces(load(spark, SF, "documents")).collect(), duck.sql("select doc_id, text from documents").fetchall())
    assert fill > 0.98


# 9: approximate nearest neighbours


def test_hilbert_is_a_walk_through_the_grid():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        k = ann.hilbert(grid, bits)
        assert sorted(k.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_ann_recall_and_hot_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[300:500] = x[7]  # one vector two hundred times
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(e, e.where("vec_id % 100 = 0"), share=0.05, least=60).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit, y = 0, x.astype(np.float64)
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        assert [g[0] for g in sorted(got[q])] == list(range(1, 11)) and all(g[2] == pytest.approx(d[g[1]]) for g in got[q])
        hit += len({g[1] for g in got[q]} & set(want.tolist()))
    assert hit / 150 >= 0.9
    assert [g[1] for g in sorted(got[400])] == [7, *range(300, 309)]


@pytest.mark.parametrize("clustered", [True, False])
def test_ann_window_is_measured(spark, clustered):
    rng = np.random.default_rng(6)
    n, dim = 6000, 24
    x = rng.standard_normal((n // 20, dim)).repeat(20, 0) + 0.05 * rng.standard_normal((n, dim)) if clustered else rng.standard_normal((n, dim))
    e = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = e.where("vec_id % 100 = 0")
    v = ann.usable(e)
    points = ann.points_of(v, 10)
    asked = ann.usable(q).alias("q").join(points.alias("p"), F.expr("q.v = p.v")).select("p.pid")
    w = ann.measured_window(points, ann.ranked(points, ann.CURVES, ann.DIMS, ann.BITS, ann.SEED), asked, 10)
    assert (w < 100) == clustered
    got = defaultdict(set)
    for r in ann.search(e, q, least=1).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for i in range(0, n, 100):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(got[i] & set(np.argsort(d)[:10].tolist()))
    assert hit / (n // 10) >= 0.93


# 10 and the pipeline


def test_fences_follow_their_group(spark):
    rows = [(i, "word " * 3 + " ".join(words(random.Random(i), 80)), "en", f"s{i % 2}") for i in range(120)]
    rows += [(200 + i, " ".join(w + "###" for w in words(random.Random(i), 80)), "en", "s0") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(120)) and not any(got[200 + i] for i in range(20))


def test_pipeline_against_brute_force(spark, duck):
    docs = duck.sql("select doc_id, text, lang, source, n_chars from documents").fetchall()
    kept = {r[0] for r in duck.sql(f"select doc_id from ({quality.OP10_SQL}) where kept").fetchall()}
    one = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert {r["doc_id"] for r in one.collect()} == kept
    duck.register("kept_ids", __import__("pandas").DataFrame({"doc_id": sorted(kept)}))
    texts = dict(duck.sql(f"select doc_id, text from ({linededup.OP6_SQL.replace('from documents)', 'from documents where doc_id in (select doc_id from kept_ids))')})").fetchall())
    two = corpus_pipeline.STAGES[1][1](spark, one, SF)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in two.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    three = corpus_pipeline.STAGES[2][1](spark, two, SF)
    want = sorted(i for i, (_, c) in brute_components(list(texts.items())).items() if i == c)
    assert sorted(r["doc_id"] for r in three.collect()) == want
    check_pieces(corpus_pipeline.run(spark, SF).collect(), [(i, texts[i]) for i in want])


STORY = "<div class='story-x'><p>The history of the river is long and it was told by the people who had lived on the banks for many years, as they were able to see.</p><p>It goes on about the towns which lie on it, and what has been built there by those of old, as you have been told.</p></div>"
STORY_TEXT = ["The history of the river is long", "It goes on about the towns"]
SAID = "I think this is the best article that I have read on the subject for a long time, and I would like to thank you for it."


@pytest.mark.parametrize(
    "page, kept",
    [
        # comments by what they hold, whatever their container is called
        (f"{STORY}<div id='user-feedback'><h3>2 opinions</h3><div class='op'><p>{SAID}</p><a>Reply</a></div><div class='op'><p>{SAID}</p><a>Reply</a></div></div>", STORY_TEXT),
        (f"{STORY}<h2>Was andere sagen</h2>\n<ul><li class=c>{SAID} <a>Antworten</a><ul><li class=c>{SAID}<a>Antworten</a></ul><li class=c>{SAID} <button>Antworten</button>", STORY_TEXT),
        # a forum's posts are its text
        (f"<div class='op'><p>{SAID}</p><a>Reply</a></div><div class='op'><p>{SAID} {SAID}</p><a>Reply</a></div>", [SAID, f"{SAID} {SAID}", "I think"]),
        # a link to reply under the article itself
        (f"<div class='post'>{STORY}<a>Reply</a></div><div class='talk'><p>{SAID}</p></div>", [*STORY_TEXT, SAID]),
        # a sure word beside others, with a control and without one
        ("<div class='gdpr-msg'><p>We use cookies and the like to make it work for you, as it is with all the sites that you have seen.</p><button>OK</button></div>" + STORY, STORY_TEXT),
        (f"<div class='cookie-recipe'><p>{SAID}</p></div>" + STORY, [SAID, *STORY_TEXT]),
        (f"<div class='has-comments'>{STORY}<form><input></form></div>", STORY_TEXT),
    ],
)
def test_containers_by_what_they_hold(page, kept):
    from stackroom.llm.htmltext import main_text

    lines = main_text(f"<body>{page}</body>").split("\n")
    assert all(any(x.startswith(k) for x in lines) for k in kept[:2])
    assert all(any(x.startswith(k) for k in kept) for x in lines)
