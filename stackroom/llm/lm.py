"""Operator 5, LM scoring: context-tree weighting over bytes, beside a smoothed unigram base.

Model. Each byte is eight binary decisions along its bits; every decision has its own context tree, whose
depths are the DEEP bytes before it. A node at depth d holds the zeros and ones seen there and their
Krichevsky-Trofimov estimate; its weighted probability is half that estimate, half the product of its
children's. The weights of all depths give a fixed mixture along each path: the root's estimate with its
posterior weight, the rest to the next depth, down to the deepest context seen in training. The sum of
log10 over a text's bytes and an end mark is its score; `bits_per_byte` its code length per byte.

Counts of (context, byte) are summed over all training texts. Those of DEEP bytes grow with the corpus and stay
in Spark, as packed arrays by range of their last DEPTH bytes, so that each range holds whole subtrees. Their
products go up to the driver for the nodes at DEPTH alone (at most 256^(DEPTH + 1) counts, whatever the corpus),
which gives the mixture down to there; it is broadcast, and each range goes on from it. The probabilities of at
most GRAM_MAX of the most frequent (context, byte) pairs (12 bytes each) are broadcast and resolve most places
where they are; all others are dealt to their range, and their sums go back by text, as in the base. A range that is
asked for more than PIECE times is looked up in several tasks.

Base. Word counts know no bound, so they stay in Spark, as packed arrays by hash range. At most HOT_MAX of
the most frequent words (16 bytes each) are broadcast, which resolves most tokens where they are; all other
(text, word) entries are dealt to the word's range, meet its count there, and their sums go back by text.
A word is known by 64 bits of its hash. The end of a text is a token of its own.

Texts whose crc32(doc_id as text) mod FOLDS is not 0 train; the others are held out.

Defined cases: a null text is empty (one token, its end); a null doc_id counts as the id "" (held out);
repeated rows train and are scored row by row; pairs of equal counts are broadcast all or none; a very long
text is scored whole, in one worker's memory; without any training text all counts are 0; an empty table
gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, lean, load, mix, parts, ship, sliced, store, word_hashes

DEPTH, DEEP, FOLDS = 2, 5, 10
HOT_MAX = GRAM_MAX = 1 << 20
RUN = 1 << 21
#: Entries of a range that one task looks up at once; a row that holds more (RUN at most) stays whole.
PIECE = 1 << 21
#: Bytes that occur in no UTF-8 text stand for the start and the end.
MARK = 0xFF
#: The hash that stands for a text's end: that of a word with white space, which no word has.
END_TOKEN = np.uint64(xxhash.xxh3_64_intdigest(b"\n end"))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0: Stirling's series eight places up, brought back by the recurrence."""
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        out = out - np.log(x + k)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1)


def joined(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of texts, each after `depth` marks and before one, and where each text starts."""
    pad = bytes([MARK]) * depth
    buf = np.frombuffer(pad + b"".join([t + b"\xff" + pad for t in texts]), np.uint8)
    size = np.array([len(t) + 1 + depth for t in texts], np.int64)
    return buf, depth + np.cumsum(size) - size


def _places(buf: np.ndarray, starts: np.ndarray, texts: list[bytes], depth: int) -> np.ndarray:
    """True where a byte is predicted: texts and their end marks, not the padding."""
    on = np.ones(len(buf), bool)
    on[:depth] = False
    ends = starts + np.array([len(t) + 1 for t in texts], np.int64)
    for k in range(depth):
        on[np.minimum(ends + k, len(buf) - 1)] = False
    return on


def contexts(buf: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each place from `depth` on, the bytes before it, the last one foremost."""
    c = np.zeros(len(buf) - depth, np.uint32 if depth < 4 else np.uint64)
    for k in range(1, depth + 1):
        c = (c << c.dtype.type(8)) | buf[depth - k : len(buf) - k]
    return c


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) of each predicted place, text by text, and how many each text has."""
    buf, starts = joined(texts, depth)
    c = contexts(buf, depth).astype(np.uint32 if depth < 3 else np.uint64)
    key = (c << c.dtype.type(8)) | buf[depth:]
    return key[_places(buf, starts, texts, depth)[depth:]], np.array([len(t) + 1 for t in texts], np.int64)


def gram_counts(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(texts, depth)[0], return_counts=True)


def _nodes(ctx: np.ndarray, byte: np.ndarray, counts: np.ndarray, j: int, depth: int, top: int = 0, below: tuple[np.ndarray, np.ndarray] | None = None):
    """Decision j's nodes at the depths from `top`: ids, estimates of a one, weights, parents' places; and the products below the top ones.

    `below` (ids, ln of products) is what lies under the deepest nodes, if anything does.
    """
    node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
    ids, kt, pe, up = [], [], [], []
    for d in range(top, depth + 1):
        u, inv = np.unique(((ctx >> (8 * (depth - d))) << 8) | node, return_inverse=True)
        up.append(np.searchsorted(ids[-1], ((u >> 16) << 8) | (u & 0xFF)) if ids else np.zeros(len(u), np.int64))
        n1, n0 = np.bincount(inv, counts * bit, len(u)), np.bincount(inv, counts * (1 - bit), len(u))
        ids.append(u)
        kt.append((n1 + 0.5) / (n0 + n1 + 1))
        pe.append(log_kt(n0, n1))
    weight: list = [None] * len(ids)
    under = None if below is None else below[1][np.searchsorted(below[0], ids[-1])]
    for i in range(len(ids) - 1, -1, -1):
        if under is None:
            weight[i], log_pw = np.ones(len(pe[i])), pe[i]
        else:
            weight[i] = 1 / (1 + np.exp(np.clip(under - pe[i], -700, 700)))
            log_pw = np.logaddexp(pe[i], under) - np.log(2)
        if i:
            under = np.bincount(up[i], log_pw, len(pe[i - 1]))
    return ids, kt, weight, up, under


class ContextTree:
    """The mixture as a table: log10 probability of each byte after each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, below: tuple[np.ndarray, np.ndarray] | None = None):
        ctx, byte = (keys >> 8).astype(np.int64), (keys & 0xFF).astype(np.int64)
        counts = counts.astype(np.float64)
        seen = [np.unique(ctx >> (8 * (depth - d))) for d in range(depth + 1)]
        prob = [np.full((len(s), 256), 0.5) for s in seen]
        states: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if len(keys):
            # a context's row starts as that of the context one byte shorter
            for j in range(8):
                ids, kt, weight, up, _ = _nodes(ctx, byte, counts, j, depth, below=below)
                had, left = np.zeros(1), np.ones(1)
                for d in range(depth + 1):
                    at = up[d]
                    row = np.searchsorted(seen[d], ids[d] >> 8)
                    prob[d][row, ids[d] & 0xFF] = -(had[at] + left[at] * kt[d])  # negative: seen at this depth
                    had, left = had[at] + left[at] * weight[d] * kt[d], left[at] * (1 - weight[d])
                states.append((ids[depth], had, left))
        full = [np.abs(prob[0]) if len(seen[0]) else np.full((1, 256), 0.5)]
        rows = [np.zeros(1, np.int64)]  # row of each context of d bytes, over all of them
        base = 1
        for d in range(1, depth + 1):
            above = np.concatenate(full)[rows[d - 1][seen[d] >> 8]] if len(seen[d]) else np.zeros((0, 256))
            full.append(np.where(prob[d] < 0, -prob[d], above))
            r = np.repeat(rows[d - 1], 256)
            # all contexts of d bytes have the last byte foremost, so the shorter one is the upper part
            r[seen[d]] = base + np.arange(len(seen[d]))
            rows.append(r)
            base += len(seen[d])
        p = np.concatenate(full)
        self.depth, self.row, self.p = depth, rows[depth].astype(np.int32), p
        ids, had, left = (np.concatenate(x) for x in zip(*states, strict=True))
        by = np.argsort(ids)
        self.ids, self.had, self.left = ids[by], had[by], left[by]
        log = np.zeros((len(p), 256))
        every = np.arange(256)
        for j in range(8):
            q = p[:, (1 << j) | (every >> (8 - j))]
            log += np.log10(np.where((every >> (7 - j)) & 1, q, 1 - q))
        self.log = log.astype(np.float32).ravel()

    def score(self, texts: list[bytes]) -> np.ndarray:
        buf, starts = joined(texts, self.depth)
        v = self.log[self.row[contexts(buf, self.depth)].astype(np.int64) * 256 + buf[self.depth :]].astype(np.float64)
        v[~_places(buf, starts, texts, self.depth)[self.depth :]] = 0
        return np.add.reduceat(v, starts - self.depth)


def top_part(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = DEPTH) -> tuple[np.ndarray, ...]:
    """Counts of (context of `top` bytes, byte), and ids and ln of products below of the nodes at `top`."""
    ctx, byte = (keys >> 8).astype(np.int64), (keys & 0xFF).astype(np.int64)
    u, inv = np.unique(((ctx >> (8 * (depth - top))) << 8) | byte, return_inverse=True)
    got = [_nodes(ctx, byte, counts.astype(np.float64), j, depth, top) for j in range(8)]
    return u, np.bincount(inv, counts, len(u)).astype(np.int64), np.concatenate([g[0][0] for g in got]), np.concatenate([g[4] for g in got])


class Subtrees:
    """What lies below the shallow tree for the contexts of one range."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tree: ContextTree, depth: int):
        self.tree, self.depth, self.at = tree, depth, []
        ctx, byte = (keys >> 8).astype(np.int64), (keys & 0xFF).astype(np.int64)
        for j in range(8 if len(keys) else 0):
            ids, kt, weight, up, _ = _nodes(ctx, byte, counts.astype(np.float64), j, depth, tree.depth)
            place = np.searchsorted(tree.ids, ids[0])
            had, left = tree.had[place], tree.left[place]
            self.at.append([])
            for u, k, w, a in zip(ids[1:], kt[1:], weight[1:], up[1:], strict=True):
                self.at[j].append((u, had[a] + left[a] * k))
                had, left = had[a] + left[a] * w * k, left[a] * (1 - w)

    def log(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each (context, byte)."""
        ctx, byte = (keys >> 8).astype(np.int64), (keys & 0xFF).astype(np.int64)
        row, out = self.tree.row[ctx >> (8 * (self.depth - self.tree.depth))], np.zeros(len(keys))
        for j in range(8):
            node = (1 << j) | (byte >> (8 - j))
            p = self.tree.p[row, node]
            for d, (ids, value) in enumerate(self.at[j] if self.at else [], self.tree.depth + 1):
                want = ((ctx >> (8 * (self.depth - d))) << 8) | node
                at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                p = np.where(ids[at] == want, value[at], p)
            out += np.log10(np.where((byte >> (7 - j)) & 1, p, 1 - p))
        return out


def _gram_range(keys: np.ndarray, ranges: int, depth: int) -> np.ndarray:
    """All (context, byte) with the same last DEPTH bytes of context are in one range."""
    return (mix(keys >> np.uint64(8 * (depth - DEPTH + 1))) % np.uint64(ranges)).astype(np.int64)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inv, np.concatenate(counts), len(k)).astype(np.int64)


def corpus_counts(docs: DataFrame, ranges: int, depth: int = DEEP) -> DataFrame:
    """Packed totals over the training texts: kind 0 words, kind 1 (context, byte); by range of the key."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {0: ([], []), 1: ([], [])}

        def out(kind: int) -> pa.RecordBatch:
            k, n = _summed(*held[kind])
            for x in held[kind]:
                x.clear()
            r = _range_of(k, ranges) if kind == 0 else _gram_range(k, ranges, depth)
            by = np.argsort(r, kind="stable")
            k, n, r = k[by], n[by], r[by]
            at = np.flatnonzero(np.diff(r, prepend=-1))
            rows = [(kind, int(r[i]), k[i:j].tobytes(), n[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(k)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "rng", "keys", "counts"])

        for b in sliced(batches, "text", 2 << 20):
            b = b.filter(pa.array([not held_out(d) for d in b.column("doc_id").to_pylist()]))
            if not b.num_rows:
                continue
            words = np.append(word_hashes(b.column("text"))[0], np.full(b.num_rows, END_TOKEN))
            for kind, (k, n) in ((0, np.unique(words, return_counts=True)), (1, gram_counts(byte_texts(b.column("text")), depth))):
                held[kind][0].append(k.astype(np.uint64))
                held[kind][1].append(n)
                if sum(map(len, held[kind][0])) >= RUN:
                    yield out(kind)
        for kind in held:
            if held[kind][0]:
                yield out(kind)

    def total(t: pa.Table) -> pa.Table:
        k, n = _summed(*([np.frombuffer(x, d) for x in t[c].to_pylist()] for c, d in (("keys", "<u8"), ("counts", "<i8"))))
        return pa.table([pa.array([v], x) for v, x in ((t["kind"][0].as_py(), pa.int32()), (t["rng"][0].as_py(), pa.int32()), (k.tobytes(), pa.binary()), (n.tobytes(), pa.binary()), (len(k), pa.int64()), (int(n.sum()), pa.int64()))], names=["kind", "rng", "keys", "counts", "n_keys", "n_total"])

    packed = docs.select("doc_id", "text").mapInArrow(lean(count), "kind int, rng int, keys binary, counts binary")
    return store(packed.groupBy("kind", "rng").applyInArrow(total, "kind int, rng int, keys binary, counts binary, n_keys long, n_total long"), "counts")


def _least(words: DataFrame, most: int) -> int:
    """The least power of two of counts that at most `most` keys reach, as its exponent."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("counts").to_pylist():
                n, c = np.unique(np.log2(np.frombuffer(x, "<i8")).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(c.astype(np.int64))], ["b", "c"])

    least, total = 62, 0
    for b, c in words.select("counts").mapInArrow(sizes, "b long, c long").groupBy("b").agg(F.sum("c")).orderBy(F.desc("b")).collect():
        if (total := total + c) > most:
            break
        least = b
    return least


def _hot_words(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words above the least power of two of counts that at most HOT_MAX words exceed."""
    least = _least(words, HOT_MAX)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, n = np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8")
                on = n >= 2**least
                yield pa.RecordBatch.from_arrays([pa.array([k[on].tobytes()], pa.binary()), pa.array([n[on].tobytes()], pa.binary())], ["k", "n"])

    t = words.select("keys", "counts").mapInArrow(hot, "k binary, n binary").toArrow()
    k = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, "<u8") for x in t["k"].to_pylist()]])
    n = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<i8") for x in t["n"].to_pylist()]])
    by = np.argsort(k)
    return k[by], n[by]


def _unpack(t: pa.Table, **columns: str) -> list[np.ndarray]:
    """Packed columns, each as one array of the type given."""
    return [np.concatenate([np.zeros(0, d), *[np.frombuffer(x, d) for x in t[c].to_pylist()]]) for c, d in columns.items()]


def shallow_tree(pairs: DataFrame, depth: int) -> ContextTree:
    """The tree down to DEPTH, with what lies below."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                got = top_part(np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8"), depth)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in got], ["k", "n", "ids", "below"])

    k, n, ids, below = _unpack(pairs.select("keys", "counts").mapInArrow(lean(tops), "k binary, n binary, ids binary, below binary").toArrow(), k="<i8", n="<i8", ids="<i8", below="<f8")
    by = np.argsort(ids)
    return ContextTree(k, n, DEPTH, (ids[by], below[by]))


def _hot_pairs(pairs: DataFrame, tree, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent (context, byte) pairs, at most GRAM_MAX, and their log10 probabilities."""
    least = _least(pairs, GRAM_MAX)

    def hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist(), strict=True):
                k, n = np.frombuffer(k, "<u8"), np.frombuffer(n, "<i8")
                on = k[n >= 2**least]
                v = Subtrees(k, n, tree.value, depth).log(on).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([on.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["k", "v"])

    k, v = _unpack(pairs.select("keys", "counts").mapInArrow(lean(hot), "k binary, v binary").toArrow(), k="<u8", v="<f4")
    by = np.argsort(k)
    return k[by], v[by]


def score(docs: DataFrame, depth: int = DEEP) -> DataFrame:
    """Scores of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = parts(docs)
    totals = corpus_counts(docs, ranges, depth)
    words = totals.where("kind = 0").select(F.col("rng").alias("wrng"), "keys", "counts")
    stats = totals.where("kind = 0").agg(F.coalesce(F.sum("n_keys"), F.lit(0)), F.coalesce(F.sum("n_total"), F.lit(0))).first()
    v, n = int(stats[0]), int(stats[1])
    pairs = totals.where("kind = 1").select(F.col("rng").alias("wrng"), "keys", "counts")
    shallow = spark.sparkContext.broadcast(shallow_tree(pairs, depth))
    model = spark.sparkContext.broadcast((*_hot_pairs(pairs, shallow, depth), *_hot_words(words.select("keys", "counts"))))
    names = ["kind", "rid", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "score", "rng", "h", "rows", "tf"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_pairs, pair_value, hot, hot_n = model.value
        value = np.log10(hot_n + 0.1)
        rid = TaskContext.get().partitionId() << 40
        rare: dict[int, tuple[list, list, list]] = {1: ([], [], []), 2: ([], [], [])}

        def out(kind: int) -> pa.RecordBatch:
            h, rows, tf = (np.concatenate(x) for x in rare[kind])
            for x in rare[kind]:
                x.clear()
            r = _range_of(h, ranges) if kind == 1 else _gram_range(h, ranges, depth)
            by = np.lexsort((h, r))
            h, rows, tf = h[by], rows[by], tf[by]
            cuts = np.searchsorted(r[by], np.arange(ranges + 1))
            got = [(r, h[i:j].tobytes(), rows[i:j].tobytes(), tf[i:j].tobytes()) for r, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            none = [pa.nulls(len(got), t) for t in types[1:9]]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(got), pa.int32()), *none, *[pa.array(c, t) for c, t in zip(zip(*got, strict=True), types[9:], strict=True)]], names)

        for b in sliced(batches, "text", 2 << 20):
            texts, ids = byte_texts(b.column("text")), b.column("doc_id")
            h, size = word_hashes(b.column("text"))
            doc = np.append(np.repeat(np.arange(len(texts)), size), np.arange(len(texts)))
            size = size + 1
            u, inv = np.unique(np.append(h, np.full(len(texts), END_TOKEN)), return_inverse=True)
            at = np.searchsorted(hot, u)
            at[at == len(hot)] = 0
            hit = hot[at] == u if len(hot) else np.zeros(len(u), bool)
            val = np.where(hit, value[at], 0.0) if len(hot) else np.zeros(len(u))
            on = hit[inv]
            other = np.flatnonzero(~on)
            if len(other):
                pair, tf = np.unique(inv[other] * len(texts) + doc[other], return_counts=True)
                for x, y in zip(rare[1], (u[pair // len(texts)], rid + pair % len(texts), tf.astype("<u4")), strict=True):
                    x.append(y)
            m = len(texts)
            key, size_b = grams(texts, depth)
            text_of = np.repeat(np.arange(m), size_b)
            g, inv_g = np.unique(key.astype(np.uint64), return_inverse=True)
            at = np.searchsorted(hot_pairs, g)
            at[at == len(hot_pairs)] = 0
            hit = hot_pairs[at] == g if len(hot_pairs) else np.zeros(len(g), bool)
            log = np.bincount(text_of, (np.where(hit, pair_value[at], 0.0) if len(hot_pairs) else np.zeros(len(g)))[inv_g], m)
            other = np.flatnonzero(~hit[inv_g])
            if len(other):
                pair, tf = np.unique(inv_g[other] * m + text_of[other], return_counts=True)
                for x, y in zip(rare[2], (g[pair // m], rid + pair % m, tf.astype("<u4")), strict=True):
                    x.append(y)
            cols = [np.zeros(m, np.int32), rid + np.arange(m), ids, np.array([held_out(d) for d in ids.to_pylist()], bool), size, size_b, np.bincount(doc[on], minlength=m), np.bincount(doc, val[inv], m), log]
            yield pa.RecordBatch.from_arrays([*[c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=False)], *[pa.nulls(m, t) for t in types[9:]]], names)
            rid += m
            for kind in rare:
                if sum(map(len, rare[kind][0])) >= RUN // 2:
                    yield out(kind)
        for kind in rare:
            if rare[kind][0]:
                yield out(kind)

    schema = "kind int, rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, rng int, h binary, rows binary, tf binary"
    both = store(docs.mapInArrow(lean(run), schema), "scored")

    def by_bucket(rows: np.ndarray, total: np.ndarray, known: np.ndarray) -> pa.Table:
        """Sums by text, packed by the text's bucket."""
        r, inv = np.unique(rows, return_inverse=True)
        total, known = np.bincount(inv, total, len(r)), np.bincount(inv, known, len(r)).astype(np.int64)
        cols: list[list] = [[], [], [], []]
        bucket = r % ranges
        for g in np.unique(bucket):
            on = bucket == g
            for x, y in zip(cols, (int(g), r[on].tobytes(), total[on].tobytes(), known[on].tobytes()), strict=True):
                x.append(y)
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "r", "total", "known"])

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of a range's words by text."""
        h, rows, tf = _unpack(left, h="<u8", rows="<i8", tf="<u4")
        k, c = _unpack(right, keys="<u8", counts="<i8")
        count = np.zeros(len(h), np.int64)
        if len(k) and len(h):
            at = np.searchsorted(k, h)
            at[at == len(k)] = 0
            count = np.where(k[at] == h, c[at], 0)
        return by_bucket(rows, tf * np.log10(count + 0.1), tf * (count > 0))

    def look_deep(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of a range's (context, byte) pairs by text."""
        h, rows, tf = _unpack(left, h="<u8", rows="<i8", tf="<u4")
        if not len(h):
            return by_bucket(rows, np.zeros(0), np.zeros(0))
        u, inv = np.unique(h, return_inverse=True)
        return by_bucket(rows, tf * Subtrees(*_unpack(right, keys="<u8", counts="<i8"), shallow.value, depth).log(u)[inv], np.zeros(len(h)))

    def gather(t: pa.Table) -> pa.Table:
        r, total, known = _unpack(t, r="<i8", total="<f8", known="<i8")
        u, inv = np.unique(r, return_inverse=True)
        return pa.table([pa.array(u), pa.array(np.bincount(inv, total, len(u))), pa.array(np.bincount(inv, known, len(u)).astype(np.int64))], names=["r", "more", "more_known"])

    def summed(kind: int, side: DataFrame, fn) -> DataFrame:
        entries = both.where(f"kind = {kind}").select("rng", "h", "rows", "tf")
        # a range that many texts ask for is dealt to several tasks, each with the range's counts; a row for each range
        pieces = F.greatest(F.ceil(F.sum(F.octet_length("tf") / 4) / PIECE), F.lit(1)).cast("int")
        asked = F.broadcast(store(entries.groupBy("rng").agg(pieces.alias("pieces")), "asked"))
        dealt = entries.join(asked, "rng").withColumn("piece", F.expr("pmod(xxhash64(rows), pieces)").cast("int")).select("rng", "piece", "h", "rows", "tf")
        counts = side.join(asked, F.expr("wrng = rng")).select("wrng", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("wpiece"), "keys", "counts")
        sums = dealt.groupBy("rng", "piece").cogroup(counts.groupBy("wrng", "wpiece")).applyInArrow(lean(fn), "bucket int, r binary, total binary, known binary")
        return sums.groupBy("bucket").applyInArrow(gather, "r long, more double, more_known long")

    deep = summed(2, pairs, look_deep).select(F.col("r").alias("deep_r"), F.col("more").alias("deep"))
    j = both.where("kind = 0").select("rid", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "score").join(summed(1, words, look_up), F.expr("rid = r"), "left")
    j = j.join(deep, F.expr("rid = deep_r"), "left").withColumn("score", F.col("score") + F.coalesce("deep", F.lit(0.0)))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + 0.1 * (v + 1)))
    bits = -F.col("score") * float(np.log2(10)) / F.col("n_bytes")
    return j.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))
