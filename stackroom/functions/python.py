"""The few functions that Spark can't express: Arrow UDFs, one call per batch."""

from __future__ import annotations

import difflib
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a batch that are Python objects at a time.
ROWS = 256


def _map(fn, kind=pa.string()):
    def run(*cols: pa.Array) -> pa.Array:
        some = lambda i: [c.slice(i, ROWS).to_pylist() for c in cols]
        each = [pa.array([None if None in x else fn(*x) for x in zip(*some(i), strict=True)], kind) for i in range(0, len(cols[0]), ROWS)]
        return pa.concat_arrays(each) if each else pa.array([], kind)

    return run


def _text(fn):
    inner = _map(fn)

    def run(c: pa.Array) -> pa.Array:
        return inner(c)

    return F.arrow_udf(run, T.StringType())


nfkc = _text(lambda s: unicodedata.normalize("NFKC", s))
casefold = _text(lambda s: s.casefold())
#: Accents dropped, for the inverted index of accent-folding searches.
fold_accents = _text(lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))


def _ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return _map(lambda x, y: difflib.SequenceMatcher(None, x, y).ratio(), pa.float64())(a, b)


#: Similarity of two normalised titles by matching blocks; `levenshtein` is another measure.
title_ratio = F.arrow_udf(_ratio, T.DoubleType())


def _best(text: str, others: list[str], words: list[set], least: float) -> dict:
    """The best score, how many of the others have it, and the first of these. Words count only beside one of the longest, one more than may be missing."""
    own = set(text.split(" "))
    some = set(sorted(own, key=len)[-1 - int(len(own) * (1 - least) + 1e-9) :])
    scores = [1.0 if text in x else len(x) / len(text) if x in text else 0.0 if some.isdisjoint(w) else len(own & w) / len(own) for x, w in zip(others, words, strict=True)]
    best = max(scores, default=None)
    return {"score": best, "n": scores.count(best), "at": scores.index(best) if scores else None}


def _best_texts(texts: pa.Array, others: pa.Array, least: pa.Array) -> pa.Array:
    out = []
    for t, o, x in zip(texts, others, least, strict=True):
        have = o.as_py()
        words = [set(y.split(" ")) for y in have]
        out.append([None if y is None else _best(y, have, words, x.as_py()) for y in t.as_py()])
    return pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("n", pa.int32()), ("at", pa.int32())])))


#: Of two lists of normalised texts, the best unit score of each text of the first one in the second; scores under the least one are rough.
best_texts = F.arrow_udf(_best_texts, T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType())])))


def close_json(raw: str) -> str | None:
    """A truncated JSON object closed after its last complete value, or null."""
    import json

    start = raw.find("{")
    if start < 0:
        return None
    best, stack, quoted, escaped = None, [], False, False
    for i in range(start, len(raw)):
        c = raw[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                break
            if not stack:
                best = raw[start : i + 1]
                break
            best = raw[start : i + 1] + "".join(reversed(stack))
    if best is None:
        return None
    try:
        return json.dumps(json.loads(best), ensure_ascii=False, sort_keys=True)
    except ValueError:
        return None


recover_json = _text(close_json)
