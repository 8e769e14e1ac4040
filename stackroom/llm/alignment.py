"""Operator 13, cross-tokenizer alignment of a byte-level BPE (A) and a SentencePiece model (B).

Both encode a space and the text; A is given the space, B adds it. A string has one label for each byte: `0` no token
ends here, `1` one of A does, `2` one of B does, `3` both do. The regular expression `[012]*3` cuts it into spans up
to each `3`; a span with i labels `1` and j labels `2` is a group of i + 1 tokens of A and j + 1 of B. At each `3` one
token of A and one of B end together: a link.

Texts are cut into units, each a word with all the white space before it. A's pattern never crosses the end of a word
before white space, and no piece of B does (checked with the vocabulary; pieces that end in a carriage return are the
exception, so a text with such a return behind a word is one unit). So each distinct unit is labelled once while it stays in
a worker's table, whose size is fixed.

The bytes of linked tokens end at one place, so one token's bytes end with the other's. These pairs follow from the two
vocabularies alone (`suffix_pairs`), whatever the corpus, and are numbered; a link is such a number. So all counts of the
corpus are an array of fixed length, summed by Spark and sent to the tasks; links stay in a table in the shared folder.

Defined cases: texts that are null, empty, or whose tokens' joined bytes differ from a space and the text (U+2581 in a
text is one) have no tokens, groups or links; repeated rows count each; long texts are handled whole; an empty table gives
an empty table; further columns stay, and those with an output's name are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _schema, binary_column, default_path, spread, token_bytes, with_column
from .common import lean, load, shared_dir, ship, sliced, text_buffer

#: Units, and characters of units and groups, that a worker's table holds at most.
UNITS, CHARS = 300_000, 24_000_000
#: Characters that count as white space in A's pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A carriage return behind a word.
GLUED = re.compile(f"[^{WHITE}]\r")
SPAN = re.compile(rb"[012]*3")


def piece_bytes(sp) -> list[bytes]:
    """id -> bytes of a SentencePiece model: U+2581 is a space, and <0xHH> the byte HH."""
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def suffix_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of a token of A and one of B of which one's bytes end with the other's, as id of A * len(b) + id of B, ascending."""
    by_a, by_b = {}, {}
    for ids, tokens in ((by_a, a), (by_b, b)):
        for i, t in enumerate(tokens):
            if t:
                ids.setdefault(t, []).append(i)
    out = {i * len(b) + j for t, own in by_a.items() for k in range(len(t)) for j in by_b.get(t[k:], ()) for i in own}
    out |= {i * len(b) + j for t, own in by_b.items() for k in range(len(t)) for i in by_a.get(t[k:], ()) for j in own}
    return np.array(sorted(out), np.int64)


class Aligner:
    """Groups and links of texts, by units kept in a bounded table."""

    def __init__(self, path_a: str, path_b: str, units: int = UNITS, chars: int = CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        a, b = token_bytes(self.a), piece_bytes(self.b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (a, b))
        self.bytes_b, self.count_b = b, len(b)
        self.pairs = suffix_pairs(a, b)
        self.space = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(len(b))]
        white = re.compile(f"[^{WHITE}][{WHITE}]| [{WHITE}]")
        self.cut = all(set(p) == {" "} or not white.search(p.rstrip("\r")) for p in pieces)
        self.most_units, self.most_chars = units, chars
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.numbers = np.zeros((4, 1024), np.int64)  # of A's tokens, B's tokens, groups; where links begin
        self.pool, self.used, self.chars = np.zeros(4096, np.int32), 0, 0

    def _tokens_b(self, units: list[str]) -> list[list[int] | None]:
        """B's ids of each unit, without the space that B adds to those that don't begin with one; none if that space isn't a token of its own."""
        own = [u[0] == " " for u in units]
        ids = self.b.encode([u[1:] if o else u for u, o in zip(units, own, strict=True)], num_threads=1)
        # a lone space is the one that B would add to a text that is not empty
        return [([self.space] if u == " " else x) if o else x[1:] if x and x[0] == self.space else None for u, o, x in zip(units, own, ids, strict=True)]

    def learn(self, units: list[str]) -> None:
        ids_b = self._tokens_b(units)
        good = [k for k, (u, x) in enumerate(zip(units, ids_b, strict=True)) if x is not None and b"".join([self.bytes_b[i] for i in x]) == u.encode()]
        ids_a = [e.ids for e in self.a.encode_batch_fast([units[k] for k in good], add_special_tokens=False)]
        n_a = np.array([len(x) for x in ids_a], np.int64)
        n_b = np.array([len(ids_b[k]) for k in good], np.int64)
        all_a = np.array([i for x in ids_a for i in x], np.int64)
        all_b = np.array([i for k in good for i in ids_b[k]], np.int64)
        end_a, end_b = np.cumsum(self.size_a[all_a]), np.cumsum(self.size_b[all_b])
        # A's tokens are the unit's bytes by construction, B's were compared with it
        labels = np.full(int(end_b[-1]) if len(end_b) else 0, ord("0"), np.uint8)
        labels[end_a - 1] += 1
        labels[end_b - 1] += 2
        spans = SPAN.findall(labels.tobytes())
        in_a = np.array([s.count(b"1") for s in spans], np.int64) + 1
        in_b = np.array([s.count(b"2") for s in spans], np.int64) + 1
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        link = np.searchsorted(self.pairs, all_a[last_a - 1] * self.count_b + all_b[last_b - 1]).astype(np.int32)
        # a unit's last byte ends a token of both
        upto = np.searchsorted(last_a, np.cumsum(n_a)) + 1 if len(good) else np.zeros(0, np.int64)
        text_a, text_b = list(map(str, all_a.tolist())), list(map(str, all_b.tolist()))
        each = [",".join(text_a[i - m : i]) + "|" + ",".join(text_b[j - n : j]) for i, m, j, n in zip(last_a.tolist(), in_a.tolist(), last_b.tolist(), in_b.tolist(), strict=True)]
        n, k = len(self.groups), 0
        while n + len(units) > self.numbers.shape[1]:
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)], axis=1)
        while self.used + len(link) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(link)] = link
        found: list[str | None] = [None] * len(units)
        begin = np.concatenate([[0], upto[:-1]]).astype(np.int64) if len(good) else upto
        for g, i, j in zip(good, begin.tolist(), upto.tolist(), strict=True):
            found[g] = ";".join(each[i:j])
        at = n + np.array(good, np.int64)
        self.numbers[:, n : n + len(units)] = 0
        for row, x in enumerate((n_a, n_b, upto - begin, self.used + begin)):
            self.numbers[row, at] = x
        self.used += len(link)
        for k, u in enumerate(units):
            self.rows[u] = n + k
        self.groups += found
        self.chars += sum(map(len, units)) + sum(len(x) for x in found if x)

    def column(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Tokens of A and B of each text, its groups as text, all links, and each text's offset there."""
        if len(self.rows) > self.most_units or self.chars + self.used > self.most_chars:
            self.clear()
        units = [[] if not t else UNIT.findall(" " + t) if self.cut and not GLUED.search(t) else [" " + t] for t in texts]
        new = {u for x in units for u in x}.difference(self.rows)
        if new:
            self.learn(sorted(new))
        rows, groups = self.rows, self.groups
        row = [[rows[u] for u in x] for x in units]
        text = [";".join([groups[r] for r in x]) if None not in (groups[r] for r in x) else None for x in row]
        row = [[] if s is None else x for x, s in zip(row, text, strict=True)]
        off = np.concatenate([[0], np.cumsum([len(x) for x in row])]).astype(np.int64)
        flat = np.array([r for x in row for r in x], np.int64)
        n_a, n_b, n, begin = self.numbers[:, flat]
        total = np.stack([np.concatenate([[0], np.cumsum(x)])[off] for x in (n_a, n_b, n)])
        return np.diff(total[:2], axis=1), [s or "" for s in text], self.pool[spread(begin, n)], total[2]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two files: what it has learned serves all tasks that the worker runs."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Replace the text by `n_a`, `n_b` (tokens), `groups` (`a1,a2|b1;a3|b2,b3`: ids of A and B in order) and `links` (binary, little-endian 32-bit numbers of suffix pairs)."""
    ship(docs.sparkSession)
    columns = {"n_a": "long", "n_b": "long", "groups": "string", "links": "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for b in sliced(batches, text, 1 << 20):
            n, groups, links, off = aligner.column(b.column(text).to_pylist())
            yield with_column(b.drop_columns([text]), {"n_a": pa.array(n[0]), "n_b": pa.array(n[1]), "groups": pa.array(groups, pa.string()), "links": binary_column(links.astype("<i4"), off)})

    return docs.mapInArrow(lean(run), _schema(docs.drop(text), columns))


def link_counts(links: DataFrame, size: int) -> np.ndarray:
    """How often each of the `size` suffix pairs is linked in all of `links`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(text_buffer(b.column(0))[0].view("<i4"), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    out = np.zeros(size, np.int64)
    met = links.select("links").mapInArrow(lean(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[met["pair"].to_numpy()] = met["n"].to_numpy()
    return out


def with_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Add `n_links`, `n_best` (links whose pair has its B id's highest count in the table, ties included) and `count_sum` (of the counts over links) to a stored result of `align`."""
    spark = aligned.sparkSession
    own = aligner_of(path_a, path_b)
    pairs, count_b = own.pairs, own.count_b
    n = link_counts(aligned, len(pairs))
    highest = np.zeros(count_b, np.int64)
    np.maximum.at(highest, pairs % count_b, n)
    sent = spark.sparkContext.broadcast((n, n == highest[pairs % count_b]))  # as long as the vocabularies' suffix pairs
    columns = {"n_links": "long", "n_best": "long", "count_sum": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = sent.value
        for b in sliced(batches, "links", 4 << 20):
            buf, off = text_buffer(b.column("links"))
            link = buf.view("<i4")
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[link])])[off // 4]) for x in (counts, best)]
            yield with_column(b.drop_columns(["links"]), {"n_links": pa.array(np.diff(off) // 4), "n_best": pa.array(sums[1].astype(np.int64)), "count_sum": pa.array(sums[0])})

    return aligned.mapInArrow(lean(run), _schema(aligned.drop("links"), columns))


def op13_alignment(spark: SparkSession, sf_dir: str, path_of: Callable[[str], str] = default_path) -> DataFrame:
    a, b = path_of("byte_bpe_50k.json"), path_of("piece_bpe_32k.model")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    at = f"{shared_dir(spark)}/aligned-{os.urandom(8).hex()}"
    align(docs, a, b).select("doc_id", "n_a", "n_b", digest.alias("groups_sha256"), "links").write.option("compression", "zstd").parquet(at)
    out = with_counts(spark.read.parquet(at), a, b)
    return out.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
