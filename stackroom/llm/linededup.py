"""Operator 6, line dedup: content-defined chunks of lines, repeated ones removed after byte comparison.

A text's lines are hashed (first four bytes of md5); a chunk ends after a line where the rolling hash of
the last WINDOW line hashes is divisible by EVERY, so boundaries move with their lines when others are
inserted or deleted. A line of LONG words or more is a passage by itself and has a boundary on either side.
Chunks of at least two lines, and those passages, whose 64-bit hash occurs again anywhere are compared by
their bytes: the occurrences with equal text form a class, of which the first (smallest doc_id, then hash
of the whole text, then line) stays and the others are removed. Boundaries seldom fall on a passage's own
ends, so each removal grows line by line over the chunk before and the chunk after it, as far as these lines
(by 64 bits of their hashes) are those beside the class's first occurrence.
What a removal takes stands in another place that comes earlier in the order of classes, so one copy of each
line remains.

Only (id, hash, place) of chunks is counted over the corpus; counts are pre-aggregated before the shuffle,
so a chunk in a third of all rows costs a row per task. Texts of repeated chunks alone are shuffled, and
the removals are joined to the documents by a broadcast only if their counted chunks are within a bound.

Defined cases: a null text stays null and has no lines; single-line chunks of fewer than LONG words go only
beside a removed chunk; a text may become empty; rows that are equal in id and text are treated alike, so
neither is removed for the other's sake; a very long text is cut whole, in one worker's memory; an empty
table gives an empty table; further columns stay, and one with an output's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, load, ship, sliced, small_join, store

WINDOW, FACTOR, EVERY = 2, 31, 3
#: Words from which on a line is a chunk of its own.
LONG = 25
#: Classes that are broadcast at most, and lines beside their first occurrences (of 8 bytes) that go with them; beyond, Spark shuffles.
CLASSES, BESIDE = 200_000, 1_000_000
#: Removed chunks (of 8 bytes) that are broadcast to the documents at most.
BOUND = 1_000_000
CHUNKS = "doc_id long, th long, start int, n int, h long"


def cut(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of each chunk."""
    h = np.frombuffer(b"".join([hashlib.md5(x).digest()[:4] for x in lines]), ">u4").astype(np.uint64)
    roll = h.copy()
    power = 1
    for k in range(1, WINDOW):
        power *= FACTOR
        roll[k:] += h[:-k] * np.uint64(power)
    ends = (roll & np.uint64(0xFFFFFFFF)) % np.uint64(EVERY) == 0
    alone = np.array([is_long(x) for x in lines], bool)
    ends |= alone
    ends[:-1] |= alone[1:]
    ends[-1] = True
    bounds = [0, *(np.flatnonzero(ends) + 1).tolist()]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def is_long(line: bytes) -> bool:
    return len(line) >= 2 * LONG - 1 and len(line.split()) >= LONG


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _chunks(docs: DataFrame, with_text: bool, mask: int) -> DataFrame:
    """Chunks of two lines or more, or of one long line; where asked, with their bytes and the hashes of the lines before (nearest first) and after."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "th", "start", "n", "h", "chunk", "before", "after"]
    used = len(names) if with_text else 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            rows = []
            for d, th, t in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if not t:
                    continue
                lines = t.split(b"\n")
                beside = [_signed(xxhash.xxh3_64_intdigest(x)) for x in lines] if with_text else []
                chunks = cut(lines)
                for k, (start, n) in enumerate(chunks):
                    if n > 1 or is_long(lines[start]):
                        chunk = b"\n".join(lines[start : start + n])
                        row = [d, th, start, n, _signed(xxhash.xxh3_64_intdigest(chunk) & mask)]
                        if with_text:
                            least = chunks[k - 1][0] if k else 0
                            most = sum(chunks[k + 1]) if k + 1 < len(chunks) else len(lines)
                            row += [chunk, beside[least:start][::-1], beside[start + n : most]]
                        rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * used
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=False)], names[:used])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(lean(run), CHUNKS + (", chunk binary, before array<long>, after array<long>" if with_text else ""))


def _alike(a: str, b: str) -> Column:
    """How many elements two arrays have in common at their beginnings."""
    return F.expr(f"transform(array(zip_with({a}, {b}, (x, y) -> if(x <=> y, 1, 0))), z -> if(array_position(z, 0) = 0, size(z), int(array_position(z, 0)) - 1))[0]")


def _removed(found: DataFrame) -> DataFrame:
    """Occurrences (with `first` and `beside` of their class) but the first, as the lines to remove."""
    later = found.where(~F.expr("struct(doc_id, th, start) <=> first"))
    back, on = _alike("before", "beside.before"), _alike("after", "beside.after")
    return later.select("doc_id", "th", (F.col("start") - back).alias("start"), (F.col("n") + back + on).alias("n"))


def removals(docs: DataFrame, mask: int = (1 << 64) - 1) -> DataFrame:
    """(doc_id, th, gone): the chunks (start, n) to remove from the row with that id and hash of its text.

    Any `mask` of the hash gives the same rows, for bytes decide; a narrow one makes hashes meet, in tests.
    """
    ship(docs.sparkSession)
    again = _chunks(docs, False, mask).groupBy("h").count().where("count > 1").select("h")
    again = small_join(store(again, "lines"), 1_000_000)
    found = store(_chunks(docs, True, mask).join(again, "h", "left_semi"), "chunks")
    key, beside = F.struct("doc_id", "th", "start"), F.struct("before", "after")
    # least and greatest bytes are equal: all texts with this hash are the same
    g = found.groupBy("h").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"), F.min(key).alias("first"), F.min_by(beside, key).alias("beside"), F.count("*").alias("c"))
    g = store(g.select("h", F.expr("lo = hi").alias("same"), "first", "beside", "c"), "classes")
    classes = g.where("same and c > 1").select("h", "first", "beside")
    size = classes.agg(F.count("*"), F.sum(F.size("beside.before") + F.size("beside.after"))).first()
    if size[0] <= CLASSES and (size[1] or 0) <= BESIDE:
        classes = F.broadcast(classes)
    gone = _removed(found.join(classes, "h"))
    if not g.where("not same").isEmpty():  # different texts with one 64-bit hash: compared by their bytes
        mixed = found.join(small_join(g.where("not same").select("h")), "h", "left_semi")
        first = mixed.groupBy("h", "chunk").agg(F.min(key).alias("first"), F.min_by(beside, key).alias("beside"), F.count("*").alias("c")).where("c > 1").select(F.col("h").alias("h0"), F.col("chunk").alias("chunk0"), "first", "beside")
        gone = gone.unionByName(_removed(mixed.join(first, F.expr("h = h0 and chunk = chunk0"))))
    return gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("gone"))


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """`docs` with `text` rewritten; with counts also n_lines and n_removed."""
    gone = store(removals(docs), "gone").withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BOUND:
        gone = F.broadcast(gone)
    d = docs.alias("d").join(gone, F.expr("d.doc_id <=> __id and xxhash64(d.text) = __th"), "left")
    lines = "flatten(transform(gone, g -> sequence(g.start, g.start + g.n - 1)))"
    # an array of one element names what is used again and again, so that it is made once
    kept = F.expr(f"transform(array(struct(split(d.text, '\\n', -1) as l, {lines} as out)), v -> array_join(transform(array_except(sequence(0, size(v.l) - 1), v.out), i -> v.l[i]), '\n'))[0]")
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(kept)
    more = {"n_lines": F.coalesce(F.size(F.split("d.text", "\n", -1)), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(F.array_distinct(F.expr(lines))), F.lit(0)).cast("long")} if counts else {}
    more = {k: F.when(F.col("gone").isNull(), F.lit(0)).otherwise(v).cast("long") if k == "n_removed" else v for k, v in more.items()}
    return d.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns if c not in more], *[v.alias(k) for k, v in more.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_removed", "text")


OP6_SQL = f"""
with d as (select doc_id, text, list_transform(string_split(text, chr(10)), lambda x: ('0x' || substr(md5(x), 1, 8))::bigint) h, string_split(text, chr(10)) l from documents),
x as (select doc_id, unnest(range(0, len(l))) i, unnest(l) line, unnest(h) h from d where text is not null),
w as (select *, len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '')) >= {LONG} long from x),
r as (select *, (h + {FACTOR} * coalesce(lag(h) over (partition by doc_id order by i), 0)) % 4294967296 % {EVERY} = 0 or long or coalesce(lead(long) over (partition by doc_id order by i), false) e from w),
c as (select *, coalesce(sum(e::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) k from r),
every as (select doc_id, k, min(i) start, count(*) n, string_agg(line, chr(10) order by i) chunk, list(line order by i) ls, bool_or(long) long from c group by doc_id, k),
sides as (select *, coalesce(list_reverse(lag(ls) over (partition by doc_id order by k)), []) b, coalesce(lead(ls) over (partition by doc_id order by k), []) a from every),
g as (select *, count(*) over (partition by chunk) m, row_number() over v rn, first_value(b) over v fb, first_value(a) over v fa from sides where n > 1 or long window v as (partition by chunk order by doc_id, start)),
q as (select *, len(list_filter(range(1, least(len(b), len(fb)) + 1), lambda j: b[1:j] = fb[1:j])) back, len(list_filter(range(1, least(len(a), len(fa)) + 1), lambda j: a[1:j] = fa[1:j])) ahead from g where rn > 1),
gone as (select distinct doc_id, unnest(range(start - back, start + n + ahead)) i from q),
kept as (select c.* from c anti join gone using (doc_id, i))
select d.doc_id, coalesce(len(l), 0)::bigint n_lines, (coalesce(len(l), 0) - coalesce(t.n, 0))::bigint n_removed, case when d.text is null then null else coalesce(t.text, '') end as text
from d left join (select doc_id, count(*) n, string_agg(line, chr(10) order by i) as text from kept group by doc_id) t using (doc_id)
"""
