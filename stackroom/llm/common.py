"""Helpers shared by the training-data operators: reading, shipping, shared storage, byte-level words."""

from __future__ import annotations

import ctypes
import gc
import inspect
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker; bounds its memory whatever the Arrow batch size is.
SLICE_BYTES = 6 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors once per application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp()) / f"{root.name}_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(out))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one of spark.checkpoint.dir; one of our own only in local mode where that is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file:///tmp/checkpoints/stackroom"
    return f"{at.rstrip('/')}/stackroom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application has stored; to be called when the results that read them are written."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """A table written to the shared folder: cuts lineage, survives lost executors, and is dropped when superseded."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def store(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def parts(df: DataFrame, each: int = 64 << 20) -> int:
    """How many pieces keyed work over `df` is dealt into: one for every `each` bytes that its plan expects, and the session's shuffle partitions at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 50  # a frame made in memory counts as endless
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each) if known else 1)


def ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with `rank` (from 0) in the order of the keys, nulls first: ranges are sorted by themselves, and each begins where those before it end."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(parts(df), *keys).sortWithinPartitions(*keys)
    at = Stored(ranges.withColumn("_at", F.monotonically_increasing_id()), name).df
    range_of = F.shiftright("_at", 33)
    # a row for each range
    sizes = sorted(at.groupBy(range_of.alias("k")).agg(F.count("*").alias("n")).collect())
    before, begin = [], 0
    for k, n in sizes:
        before.append((k, begin))
        begin += n
    first = F.broadcast(spark.createDataFrame(before, "_range long, _first long"))
    return at.withColumn("_range", range_of).join(first, "_range").withColumn("rank", F.col("_at") - F.shiftleft("_range", 33) + F.col("_first")).drop("_at", "_range", "_first")


def small_join(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table with a broadcast hint if its counted rows are within the bound; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def byte_texts(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [b"" if x is None else x for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice has about `most` text bytes (one text may exceed it, whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = np.array([0 if n is None else n for n in pc.binary_length(b.column(text)).to_pylist()], np.int64)
        group = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
            yield b.slice(i, j - i)


#: Words of up to SHORT bytes are hashed by tabulation: the sum of a random value for each (place, byte).
SHORT = 32
#: Text bytes whose words are hashed at once.
STEP_BYTES = 1 << 18


def _tables(seed: int, fold: bool) -> np.ndarray:
    if (seed, fold) not in _TABLES:
        t = np.random.default_rng([seed, 77]).integers(0, 1 << 64, (SHORT, 256), np.uint64)
        if fold:
            t[:, 65:91] = t[:, 97:123]
        _TABLES[seed, fold] = t
    return _TABLES[seed, fold]


_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its texts' offsets there; null is the empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, "<i8" if wide else "<i4")[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def in_word(buf: np.ndarray) -> np.ndarray:
    """True for bytes of words; all others are ASCII white space."""
    return ((buf - np.uint8(9)) > 4) & (buf != 32)


def _step_ends(buf: np.ndarray) -> list[int]:
    """Where the bytes may be cut: every STEP_BYTES, moved on to the end of a word."""
    out, at = [], 0
    while at < len(buf):
        at = min(at + STEP_BYTES, len(buf))
        while at < len(buf) and in_word(buf[at - 1 : at])[0]:
            inside = in_word(buf[at : at + 4096])
            n = int(np.argmin(inside))
            if not inside[n]:
                at += n
                break
            at = min(at + 4096, len(buf))
        out.append(at)
    return out


def word_hashes(col: pa.Array, seed: int = 0, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and the number of words of each text."""
    return words_of(*text_buffer(col), seed, fold)[:2]


def words_of(buf: np.ndarray, off: np.ndarray, seed: int = 0, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of the texts that lie in `buf` at `off`, each text's number of words, and where words begin and end.

    Words are runs of bytes without ASCII white space; with `fold`, A-Z counts as a-z. All is done over whole buffers, in steps of
    a fixed size, so memory beyond the result is bounded however long a text or word is.
    """
    table = _tables(seed, fold)
    first = off[:-1][off[1:] > off[:-1]]  # where texts begin
    hashes, places, counted = [], [], np.zeros(len(off), np.int64)
    begin = words = 0
    for end in _step_ends(buf):
        inside = in_word(buf[begin:end])
        cut = first[np.searchsorted(first, begin) : np.searchsorted(first, end)] - begin
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[cut] = inside[cut]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        after = cut[cut > 0]
        stop[after - 1] = inside[after - 1]
        a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
        here = slice(np.searchsorted(off, begin, side="right" if begin else "left"), np.searchsorted(off, end, side="right"))
        counted[here] = words + np.searchsorted(a, off[here] - begin)
        if len(a):
            n = np.minimum(b - a, SHORT).astype(np.uint8)
            by = np.argsort(-n.astype(np.int8), kind="stable")  # longest first: the words that reach a place come before the others
            at, sums, part = a[by], np.zeros(len(a), np.uint64), buf[begin:end]
            reach = len(a) - np.cumsum(np.bincount(n, minlength=SHORT + 1))
            for place in range(int(n.max())):
                k = int(reach[place])
                sums[:k] += table[place].take(part.take(at[:k]))
                at[:k] += 1
            h = np.empty(len(a), np.uint64)
            h[by] = sums
            for i in np.flatnonzero(b - a > SHORT):
                word = buf[begin + a[i] : begin + b[i]].tobytes()
                h[i] = xxhash.xxh3_64_intdigest(word.lower() if fold else word, seed)
            hashes.append(h)
            places.append((begin + a, begin + b))
            words += len(a)
        begin = end
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*places, strict=True)) if places else (none, none)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.diff(counted), a, b


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def trim() -> None:
    """Give memory that is free inside the worker back to the machine: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel


def lean(fn):
    """A function over batches or groups after which free memory is given back."""

    def over(out):
        if isinstance(out, pa.Table):
            trim()
            return out
        return over_batches(out)

    def one(data):
        return over(fn(data))

    def two(left, right):
        return over(fn(left, right))

    def over_batches(out):
        try:
            yield from out
        finally:
            trim()

    # Spark reads the number of parameters
    return two if len(inspect.signature(fn).parameters) == 2 else one
