"""Operator 4, byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

`encode` gives each row the ids of its whole text; `decode` reverses the byte table. A vocabulary given
as ranks is turned into merges once per worker: every split of a token into two tokens is a merge of
that token's rank, which is the order in which a rank table merges. Texts go through the library in
units, each a word with all the white space before it. The pattern cuts a run of white space as a whole,
and nothing that comes before the run matters, so a unit has the same ids alone as in its text, and each
distinct unit is encoded once per worker, over all its tasks, while it stays in a table of fixed size,
where whole columns are looked up at once. Only texts with `<|`, or with white space other than ASCII's
beside ASCII white space, go to the library whole.

Offsets: the bytes of a token are known from the byte table, so its first and last character follow
from a running count of the bytes that start characters; a character split over tokens belongs to each
of them. `decode_span` handles ids cut inside a character.

Defined cases: a null text is empty and has no ids; repeated rows are encoded row by row; a very long text
is encoded whole, in one worker's memory; an empty table gives an empty table; further columns of the input
stay, and one with an output's name is replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_word, load, ship, sliced, text_buffer, words_of

CACHE_UNITS = 700_000
#: Units given to the library in one string, and strings in one call: what it returns is many times their size.
JOINED, CALL = 100, 100


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The byte-to-character mapping of byte-level BPE: printable bytes stand for themselves, the others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_of_ranks(ranks: dict[bytes, int]):
    from tokenizers import Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    text = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [(text[t[:i]], text[t[i:]]) for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return tok


def token_bytes(tok) -> list[bytes]:
    """id -> bytes, by reversing the byte table."""
    back = {c: bytes([i]) for i, c in enumerate(byte_chars())}
    out = [b""] * (max(tok.get_vocab().values(), default=-1) + 1)
    for t, i in tok.get_vocab().items():
        out[i] = b"".join(back.get(c, c.encode()) for c in t)
    return out


_made: dict[str, tuple] = {}


def made(path: str) -> tuple:
    """(tokenizer, token bytes) of a file, once per worker."""
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path) if path.endswith(".json") else tokenizer_of_ranks(read_ranks(path))
        _made[path] = (tok, token_bytes(tok))
    return _made[path]


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of runs of these lengths, one run after another."""
    end = np.cumsum(length)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - length), length)


def irregular(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts that go to the library whole: with `<|`, or with other white space beside ASCII white space.

    A run of white space is cut as a whole, so a unit must hold all of the run it begins with.
    """
    out = np.zeros(len(off) - 1, bool)
    if not len(buf):
        return out
    after = np.append(buf[1:], np.uint8(0))
    bad = (buf == 60) & (after == 124)
    other = (buf >= 0x1C) & (buf <= 0x1F)
    starts = np.flatnonzero(other)  # of each character of other white space
    ends = starts + 1
    lead = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    if len(lead):
        x, y, z = (np.append(buf, np.zeros(2, np.uint8))[lead + k] for k in range(3))
        two = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        general = (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        three = general | ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        starts, ends = np.concatenate([starts, lead[two | three]]), np.concatenate([ends, lead[two] + 2, lead[three] + 3])
    starts, ends = starts[starts > 0], ends[ends < len(buf)]
    at = np.concatenate([np.flatnonzero(bad), starts[~in_word(buf[starts - 1])], ends[~in_word(buf[ends])]])
    out[np.searchsorted(off, at, side="right") - 1] = True
    return out


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by units kept in a bounded table.

    A unit is a word with all the white space before it, or the white space at a text's end. It is known by 64 bits
    of its hash; the table is open-addressed over arrays, so a whole column is looked up at once.
    """

    #: Marks of a word behind nothing or a line break (which is a token of its own), and behind a space.
    MARKS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344], np.uint64)

    def __init__(self, tok, most: int = CACHE_UNITS):
        self.tok, self.most = tok, most
        self.line = self._ids("\n")
        assert len(self.line) == 1
        self._clear(most)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _clear(self, room: int) -> None:
        bits = max(10, int(room / 0.7).bit_length())  # at most seven tenths full
        self.room, self.shift, self.n = room, np.uint64(64 - bits), 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.begin, self.length, self.pool = np.zeros(room, np.int32), np.zeros(room, np.int32), np.zeros(4 * room, "<u4")
        self.hits = np.zeros(room, np.int32)
        self.used = 0

    def _forget(self, room: int) -> None:
        """Empty the table but for the units met again, if these leave half of it free."""
        kept = np.flatnonzero(self.hits[: self.n] > 1)
        if 2 * len(kept) > room:
            kept = kept[:0]
        key = np.zeros(self.n, np.uint64)
        some = self.keys != 0
        key[self.rows[some]] = self.keys[some]
        length = self.length[kept].astype(np.int64)
        ids = self.pool[spread(self.begin[kept], length)]
        self._clear(room)
        self._put(key[kept], length, ids)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 where there is none."""
        out, todo, at = np.full(len(key), -1, np.int64), np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            hit = there == key[todo]
            out[todo[hit]] = self.rows[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def _learn(self, key: np.ndarray, units: list[str], together: bool) -> None:
        """Put units in the table; their keys are new. Without line breaks inside many go through the library `together`."""
        step = JOINED if together else 1
        for k in range(0, len(units), step * CALL):
            part = units[k : k + step * CALL]
            joined = ["\n".join(part[i : i + step]) + "\n" * together for i in range(0, len(part), step)]
            some = [e.ids for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(some), "<u4", sum(map(len, some)))
            if together:
                length, ids = np.diff(np.flatnonzero(ids == self.line[0]), prepend=-1) - 1, ids[ids != self.line[0]]
            else:
                length = np.array([len(x) for x in some], np.int64)
            self._put(key[k : k + step * CALL], length, ids)

    def _put(self, key: np.ndarray, length: np.ndarray, ids: np.ndarray) -> None:
        n, end = len(key), np.cumsum(length)
        self.begin[self.n : self.n + n] = self.used + end - length
        self.length[self.n : self.n + n] = length
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(ids), len(self.pool) // 8), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        todo, slot = np.arange(n), (key >> self.shift).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[todo[free]]  # of those that want one place, one has it
            mine = free & (self.keys[slot] == key[todo])
            self.rows[slot[mine]] = self.n + todo[mine]
            todo, slot = todo[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)
        self.n += n

    def _units(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Keys of all units, where their bytes begin and end, what stands before them (0 nothing, 1 a space, 2 a line break, 3 other white space), and each text's number."""
        h, count, a, b = words_of(buf, off, fold=False)
        last = np.cumsum(count)
        # the white space of a text's end is a unit without a word
        behind = off[:-1].copy()
        behind[count > 0] = b[last[count > 0] - 1]
        tail = np.flatnonzero(behind < off[1:])
        if len(tail):
            h, a, b = np.insert(h, last[tail], np.uint64(0)), np.insert(a, last[tail], off[1:][tail]), np.insert(b, last[tail], off[1:][tail])
            count = count.copy()
            count[tail] += 1
        lo = np.empty(len(a), np.int64)
        lo[1:] = b[:-1]
        first = (np.cumsum(count) - count)[count > 0]
        lo[first] = off[:-1][count > 0]
        gap = a - lo
        before = np.where(gap == 0, 0, 3)
        one = (gap == 1) & (a < b)
        before[one & (buf[np.minimum(lo, len(buf) - 1)] == 32)] = 1
        before[one & (buf[np.minimum(lo, len(buf) - 1)] == 10)] = 2
        key = h ^ self.MARKS[(before == 1).astype(np.int64)]
        for i in np.flatnonzero(before == 3).tolist():
            key[i] = h[i] ^ np.uint64(xxhash.xxh3_64_intdigest(buf[lo[i] : a[i]].tobytes(), 1))
        key[key == 0] = 1
        return key, lo, b, before, count

    def _regular(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, lo, hi, before, count = self._units(buf, off)
        row = self._find(key)
        if (row < 0).any():
            miss = np.flatnonzero(row < 0)
            new, first = np.unique(key[miss], return_index=True)
            if self.n + len(new) > self.room:
                self._forget(self.most)
                miss = np.flatnonzero(self._find(key) < 0)
                new, first = np.unique(key[miss], return_index=True)
                if self.n + len(new) > self.room:
                    self._clear(max(self.most, len(key)))
                    miss = np.arange(len(key))
                    new, first = np.unique(key, return_index=True)
            at = miss[first]
            begin = lo + (before == 2)
            units = [buf[i:j].tobytes().decode("utf-8", "surrogatepass") for i, j in zip(begin[at].tolist(), hi[at].tolist(), strict=True)]
            # other white space would run together with the line breaks between units
            plain = np.array([u.split() == [u.lstrip(" ")] for u in units], bool) & (before[at] != 3)
            for together in (True, False):
                some = np.flatnonzero(plain == together)
                if len(some):
                    self._learn(new[some], [units[i] for i in some.tolist()], together)
            row = self._find(key)
        self.hits += np.bincount(row, minlength=self.room).astype(np.int32)
        length = self.length[row].astype(np.int64)
        line = before == 2
        out = np.empty(int(length.sum() + line.sum()), "<u4")
        end = np.cumsum(length + line)
        out[spread(end - length, length)] = self.pool[spread(self.begin[row], length)]
        out[(end - length - 1)[line]] = self.line[0]
        return out, np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's offset there."""
        buf, off = text_buffer(col)
        odd = irregular(buf, off)
        if not odd.any():
            return self._regular(buf, off)
        if col.null_count:
            col = pc.fill_null(col, "")
        ids, at = self._regular(*text_buffer(col.filter(pa.array(~odd))))
        parts, k = [], 0
        for text, o in zip(col.to_pylist(), odd.tolist(), strict=True):
            if o:
                parts.append(self._ids(text))
            else:
                parts.append(ids[at[k] : at[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.column(pa.array(texts, pa.string()))
        return [ids[i:j].tobytes() for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]


_encoders: dict[str, UnitEncoder] = {}


def encoder_of(path: str) -> UnitEncoder:
    """The worker's encoder for a file: what it has learned serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(made(path)[0])
    return _encoders[path]


def binary_column(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """Binary values from one array of items and the values' offsets there."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * flat.itemsize).astype("<i8")), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def char_offsets(text: bytes | np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token, from the tokens' byte lengths."""
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(starts) - 1  # of each byte
    end = np.cumsum(lengths)
    begin = end - lengths
    return (char[begin], char[end - 1] + 1) if len(lengths) else (np.zeros(0, np.int64),) * 2


def with_column(b: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in b.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *columns.values()], [*names, *columns])


def _schema(df: DataFrame, columns: dict[str, str]) -> str:
    return ", ".join([*[f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name not in columns], *[f"{n} {t}" for n, t in columns.items()]])


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = True, keep_text: bool = True) -> DataFrame:
    """Add `ids` (binary, little-endian unsigned 32-bit) and, with offsets, `char_starts` and `char_ends` of the tokens (binary, the same)."""
    ship(docs.sparkSession)
    columns = {"ids": "binary"} | ({"char_starts": "binary", "char_ends": "binary"} if offsets else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, enc = made(path)[1], encoder_of(path)
        lengths = np.array([len(t) for t in table], np.int64)
        for b in sliced(batches, text, 1 << 20):
            col = b.column(text)
            ids, at = enc.column(col)
            new = {"ids": binary_column(ids, at)}
            if offsets:
                # tokens cover the texts' bytes in order, so all texts are one; each counts its characters from its own start
                buf, off = text_buffer(col)
                first, end = char_offsets(buf, lengths[ids])
                before = np.repeat(np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off[:-1]], np.diff(at))
                new |= {n: binary_column((x - before).astype("<u4"), at) for n, x in (("char_starts", first), ("char_ends", end))}
            out = with_column(b, new)
            yield out if keep_text else out.drop_columns([text])

    kept = _schema(docs if keep_text else docs.drop(text), columns)
    return docs.mapInArrow(run, kept)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replace `ids` by `decoded` (binary): the bytes of its tokens."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = made(path)[1]
        lengths = np.array([len(t) for t in table], np.int64)
        begin, pool = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(table), np.uint8)
        for b in sliced(batches, ids, 1 << 20):
            buf, off = text_buffer(b.column(ids))
            x = np.frombuffer(buf.tobytes(), "<u4")
            ends = np.concatenate([[0], np.cumsum(lengths[x])])
            raw = pool[spread(begin[x], lengths[x])]
            yield with_column(b.drop_columns([ids]), {"decoded": binary_column(raw, ends[off // 4])})

    return rows.mapInArrow(run, _schema(rows.drop(ids), {"decoded": "binary"}))


def decode_span(ids: list[int], table: list[bytes]) -> tuple[bytes, str, bytes]:
    """(bytes that end a character begun before, text, bytes that begin a character not ended) of a cut from a sequence."""
    raw = b"".join(table[i] for i in ids)
    head = 0
    while head < min(3, len(raw)) and raw[head] & 0xC0 == 0x80:
        head += 1
    tail = len(raw)
    for back in range(1, min(4, len(raw) - head) + 1):
        b = raw[-back]
        if b & 0xC0 == 0x80:
            continue
        need = 4 if b >= 0xF0 else 3 if b >= 0xE0 else 2 if b >= 0xC0 else 1
        tail = len(raw) - back if need > back else tail
        break
    return raw[:head], raw[head:tail].decode("utf-8", "replace"), raw[tail:]


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path_of: Callable[[str], str] = default_path) -> DataFrame:
    path = path_of("byte_bpe_multi_50k.tiktoken")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.sha2(F.concat("char_starts", "char_ends"), 256)
    e = encode(docs, path, keep_text=False).select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), spans.alias("offsets_sha256"))
    return decode(e, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "offsets_sha256")
