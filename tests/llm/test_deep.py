"""The context tree below its broadcast part."""

import numpy as np
import pytest

from stackroom.llm import lm

from .test_methods import brute_ctw

TEXTS = ["abracadabra abracadabra", "", "été banana band", "abra banana", "zebra", "the band of the zebra"]


@pytest.mark.parametrize("depth", [3, 5])
def test_subtrees_against_brute_force(depth):
    train = [t.encode() for t in TEXTS[:4]]
    keys, counts = lm.gram_counts(train, depth)
    k, n, ids, below = lm.top_part(keys, counts, depth)
    by = np.argsort(ids)
    sub = lm.Subtrees(keys, counts, lm.ContextTree(k, n, lm.DEPTH, (ids[by], below[by])), depth)
    for t in TEXTS:
        assert sub.log(lm.grams([t.encode()], depth)[0]).sum() == pytest.approx(brute_ctw(train, t.encode(), depth), rel=1e-5)


@pytest.mark.parametrize("hot", [0, 20, 1 << 20])
def test_scores_see_five_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "GRAM_MAX", hot)
    monkeypatch.setattr(lm, "PIECE", 40)  # ranges are looked up in several tasks
    rows = [(i, t) for i, t in enumerate(TEXTS * 4)]
    train = [t.encode() for i, t in rows if not lm.held_out(i)]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(rows) and any(r["held_out"] for r in got.values())
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(brute_ctw(train, t.encode(), 5), rel=1e-5)
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] * np.log2(10) / (len(t.encode()) + 1))
