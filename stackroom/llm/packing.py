"""Operator 8, packing: order-preserving dynamic programming over document and sentence boundaries.

Each input partition is a stream of documents in its order: a document's ids, then END. Windows of at most
LENGTH tokens follow one another; a window costs its padding, and each cut a penalty: none at a document's
end, SENTENCE after a sentence, HARD inside a sentence of more than GAP tokens (every STEP tokens). With
g(j) = cost up to boundary j + its position, g(j) = LENGTH + penalty(j) + min g(i) over the boundaries i of
the last LENGTH tokens, whose minimum a monotone queue keeps.

The stream is solved BLOCK tokens at a time. The best cuts of the whole stream end in one of the boundaries
of a block's last LENGTH tokens, so the cuts that the best ways to all of these share are final; the rest is
solved again with the next block. So the result is the best for the stream, however blocks fall. Until a cut is
shared the tokens read (4 bytes each) are kept, those of one input partition at most, and each try reads twice as
many; on the tables the first block always has one. Nothing is shuffled: sequences are numbered by partition, and
a retried task gives the same rows.

A sentence ends at a token with a line break, or at one that closes with `.`, `!` or `?` (and quotes or
brackets behind) before a token that begins with white space and no lower-case letter, so "3.14", "e.g. it"
and addresses are not cut. Ids are those of the tokenizers library and file, by units (see operator 4).

Defined cases: a null or empty text is END alone; a very long text is cut like any other; repeated rows are
packed row by row; of cuts that cost the same the latest is taken; an empty table gives no piece; further
columns aren't read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder_of, made, spread
from .common import lean, load, ship, sliced

LENGTH, END = 1024, 0
SENTENCE, HARD = 3, 10
#: Sentences of more tokens than this may be cut inside, every STEP tokens.
GAP, STEP = 64, 16
BLOCK = 1 << 18
PIECES = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class Sentences:
    """Which tokens may end a sentence, from the bytes of each."""

    def __init__(self, table: list[bytes]):
        bare = [t.rstrip(b"\"')]}") for t in table]
        self.closes = np.array([t.endswith((b".", b"!", b"?")) for t in bare], bool)
        self.closer = np.array([not t and bool(u) for t, u in zip(bare, table, strict=True)], bool)
        self.line = np.array([b"\n" in t for t in table], bool)
        self.opens = np.array([t[:1].isspace() and not t.strip()[:1].islower() for t in table], bool)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """True for tokens after which a sentence has ended; the last token's successor is taken to open one."""
        closed = self.closes[ids]
        for _ in range(2):  # closing quotes and brackets that are tokens of their own
            closed[1:] |= closed[:-1] & self.closer[ids[1:]]
        opens = np.append(self.opens[ids[1:]], True)
        return self.line[ids] | (closed & opens)


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: Sentences, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending, and their penalties; the last is the end of `ids`."""
    no = np.uint8(255)
    penalty = np.full(len(ids) + 1, no, np.uint8)  # of a cut before each token, and at the end
    penalty[len(ids)] = HARD
    penalty[1:][ends.ends(ids)] = SENTENCE
    penalty[doc_ends] = 0
    pos = np.flatnonzero(penalty[1:] != no) + 1
    gaps = np.diff(pos, prepend=0)
    wide = np.flatnonzero(gaps > min(GAP, length))
    if len(wide):
        step = min(STEP, length)
        n = (gaps[wide] - 1) // step
        penalty[spread(np.zeros(len(n), np.int64), n) * step + step + np.repeat(pos[wide] - gaps[wide], n)] = HARD
        pos = np.flatnonzero(penalty[1:] != no) + 1
    return pos, penalty[pos].astype(np.int64)


def best_ways(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Positions (0 first) and, for each, the place before it on the way of least padding plus penalties; consecutive positions are at most `length` apart."""
    at, pen = [0, *pos.tolist()], [0, *penalty.tolist()]
    g, back = [0] * len(at), [0] * len(at)
    queue = deque([0])  # boundaries with increasing position and g
    for j in range(1, len(at)):
        least = at[j] - length
        while at[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        back[j] = i
        g[j] = value = g[i] + length + pen[j]
        while queue and g[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    return at, back


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows of least padding plus penalties."""
    at, back = best_ways(pos, penalty, length)
    return _way(at, back, len(at) - 1)


def _way(at: list[int], back: list[int], j: int) -> list[int]:
    cuts = []
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def final_cuts(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The cuts that the best ways to all boundaries of the last `length` tokens share; the last position is no boundary yet."""
    at, back = best_ways(pos, penalty, length)
    # whichever of these the stream goes on from, its way runs through their last common place
    heap = [-j for j in range(1, len(at) - 1) if at[j] >= at[-1] - length]
    heapify(heap)
    while len(heap) > 1:
        j = heappop(heap)
        if heap[0] != j:
            heappush(heap, -back[-j])
    return _way(at, back, -heap[0]) if heap else []


class Packer:
    """Solves a stream of documents block by block; yields (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, ends: Sentences, length: int = LENGTH, block: int = BLOCK):
        self.ends, self.length, self.block = ends, length, block
        self.docs: list[tuple] = []  # (doc_id, ids not yet placed, their start, document's tokens)
        self.held = self.sequence = 0
        self.due = block

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        # a document longer than a block is solved in parts
        for a in range(0, len(ids), self.block):
            part = ids[a : a + self.block]
            self.docs.append((doc_id, part, a, len(ids)))
            self.held += len(part)
            if self.held >= self.due:
                yield from self._solve(False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._solve(True)

    def _solve(self, final: bool) -> Iterator[tuple]:
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        true_ends = doc_ends[[d[2] + len(d[1]) == d[3] for d in self.docs]]
        found = boundaries(ids, true_ends, self.ends, self.length)
        if final:
            cuts = best_cuts(*found, self.length)
        else:
            cuts = final_cuts(*found, self.length)
        a, k, left = 0, 0, 0  # left: ids of document k already placed
        for b in cuts:
            offset = 0
            while a < b:
                doc_id, part, start, total = self.docs[k]
                n = min(b - a, len(part) - left)
                yield doc_id, start + left, part[left : left + n].tobytes(), total, self.sequence, offset
                a, offset, left = a + n, offset + n, left + n
                if left == len(part):
                    k, left = k + 1, 0
            self.sequence += 1
        rest = self.docs[k:]
        if rest and left:
            doc_id, part, start, total = rest[0]
            rest[0] = (doc_id, part[left:], start + left, total)
        self.docs, self.held = rest, len(ids) - a
        # without a common cut twice as much is read before the next try, so no token is solved more than twice on average
        self.due = self.held + self.block if cuts else 2 * self.held


def pack(docs: DataFrame, json_path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of the documents (doc_id, text) with their ids, sequence and offset there."""
    ship(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(json_path), Packer(Sentences(made(json_path)[1]), length)
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            cols[4] = [base + s for s in cols[4]]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
            rows.clear()
            return out

        for b in sliced(batches, "text", 1 << 20):
            ids, at = encoder.column(b.column("text"))
            for doc_id, i, j in zip(b.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                rows.extend(packer.add(doc_id, np.append(ids[i:j], np.uint32(END))))
                if len(rows) >= 2000:
                    yield batch()
        rows.extend(packer.finish())
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECES)


def pieces(docs: DataFrame, path_of: Callable[[str], str] = default_path) -> DataFrame:
    p = pack(docs, path_of("byte_bpe_50k.json"))
    return p.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(load(spark, sf_dir, "documents"))
