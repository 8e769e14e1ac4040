"""Calls to a model as pluggable functions: batches of messages to texts, with guards, one repair and a memo.

`Provider` is any picklable callable from text to text; `echo` is the deterministic stand-in of the tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..shipping import ship

Provider = Callable[[str], str]


def echo(prompt: str) -> str:
    """Words in reverse: the same length, placeholders kept."""
    return " ".join(reversed(prompt.split(" ")))


def call(rows: DataFrame, provider: Provider, column: str = "text", into: str = "reply", ok: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Adds the reply to each row; one that fails `ok(text, reply)` is asked for once more, and then the text stays."""

    ship(rows.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            r = provider(t)
            if ok and not ok(t, r):
                r = provider(t)
                r = r if ok(t, r) else t
            out.append(r)
        return pa.array(out, pa.string())

    return rows.withColumn(into, F.arrow_udf(run, "string").asNondeterministic()(F.col(column)))


@udtf(returnType="seq int, chunk string")
class StreamReply:
    """A reply in chunks of `size` characters."""

    def eval(self, text: str, size: int) -> Iterator[tuple[int, str]]:
        for i in range(0, len(text or ""), max(1, size)):
            yield i // max(1, size), text[i : i + max(1, size)]


def memoised(rows: DataFrame, memo: DataFrame, provider: Provider, context: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows with reply, memo with the new entries): only texts that the memo (key, reply) lacks are asked for, once each."""
    key = F.sha2(F.concat(F.lit(hashlib.sha256(context.encode()).hexdigest()), F.lit("\u0001"), F.col("text")), 256)
    r = rows.withColumn("key", key)
    missing = r.select("key", "text").distinct().join(memo.select("key"), "key", "left_anti")
    every = memo.unionByName(call(missing, provider).select("key", "reply"))
    return r.join(every, "key", "left").drop("key"), every


def embed(rows: DataFrame, column: str = "text", dim: int = 64) -> DataFrame:
    """Unit vectors of hashed words: the mean over words of signed unit directions; a stand-in for a model.

    A batch's distinct words are hashed once each, and its vectors are one weighted count.
    """

    def run(texts: pa.Array) -> pa.Array:
        words = [(t or "").lower().split() for t in texts.to_pylist()]
        known = {w: int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") for w in set(chain.from_iterable(words))}
        size = [len(x) for x in words]
        h = np.fromiter((known[w] for w in chain.from_iterable(words)), np.uint64, sum(size))
        at = np.repeat(np.arange(len(words)) * dim, size) + (h % np.uint64(dim)).astype(np.int64)
        v = np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(words) * dim).reshape(len(words), dim)
        n = np.sqrt((v * v).sum(axis=1, keepdims=True))
        flat = (v / np.where(n > 0, n, 1.0)).astype("<f4").ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(flat))

    return rows.withColumn("embedding", F.arrow_udf(run, "array<float>")(F.col(column)))
