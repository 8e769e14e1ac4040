"""Folds that depend on the order of a key's rows, as one walk: a state per key, whatever the number of its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import placed, small, stored

#: Rows of a key from which on its batches are found by jumps instead of one walk, and rows of a piece of a prefix sum.
LONG, PIECE = 1_000_000, 65_536


def fold(rows: DataFrame, key: str, order: list[str], cols: list[str], start: Callable[[], dict], step: Callable[..., object], name: str, kind: str) -> DataFrame:
    """(key, *order, name): `step(state, *cols)` changes the state and gives the row's value; rows without a value are left out.

    Rows are dealt by key and sorted, and a worker streams through them with the state of one key, so neither a
    key's rows nor a partition's are ever in memory together.
    """
    ship(rows.sparkSession)
    schema = rows.select(key, *order).schema
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{name}` {kind}"
    value = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, start(), False
        for b in batches:
            got = []
            for k, *row in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in cols), strict=True):
                if not begun or k != now:
                    now, state, begun = k, start(), True
                got.append(step(state, *row))
            new = pa.RecordBatch.from_arrays([b.column(key), *(b.column(c) for c in order), pa.array(got, value)], [key, *order, name])
            yield new.filter(new.column(name).is_valid())

    dealt = rows.select(key, *order, *[c for c in cols if c not in (key, *order)]).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(run, out)


def prefix_sums(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows up to each `place` (from 1, without gaps): pieces by themselves, then the pieces before them."""
    r = rows.withColumn("__piece", F.expr(f"(place - 1) div {PIECE}"))
    w = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each piece
    before = r.groupBy("__piece").agg(F.sum(value).alias("__s")).select("__piece", F.coalesce(F.sum("__s").over(w), F.lit(0)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__piece").orderBy("place"))
    return r.join(small(stored(before, "pieces")), "__piece").withColumn(name, own + F.col("__before")).drop("__piece", "__before")


def _first_beyond(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(i, j): for each (i, limit) the first place j whose sum `upto` is greater, null if there is none; sums ascend with the places."""
    r = rows.select("place", "upto", F.expr(f"(place - 1) div {PIECE}").alias("piece"))
    ends = small(stored(r.groupBy("piece").agg(F.max("upto").alias("last")), "pieces"))
    # the piece where a limit is passed: the row's own, or the next, ...; a piece holds many batches, so few go far
    left, near = asked.withColumn("piece", F.expr(f"(i - 1) div {PIECE}")), None
    while True:
        met = stored(left.join(ends, "piece"), "met")
        here = met.where(F.col("limit") < F.col("last")).select("i", "limit", "piece")
        near = here if near is None else near.unionByName(here)
        left = met.where(F.col("limit") >= F.col("last")).select("i", "limit", (F.col("piece") + 1).alias("piece"))
        if left.isEmpty():
            break
    both = r.select("piece", F.col("upto").alias("v"), F.lit(0).alias("kind"), "place").unionByName(near.select("piece", F.col("limit").alias("v"), F.lit(1).alias("kind"), F.col("i").alias("place")))
    w = Window.partitionBy("piece").orderBy("v", "kind", "place").rowsBetween(1, Window.unboundedFollowing)
    found = both.withColumn("j", F.min(F.when(F.col("kind") == 0, F.col("place"))).over(w)).where("kind = 1")
    return found.select(F.col("place").alias("i"), "j")


def _begun(p: DataFrame, ends: DataFrame, step: DataFrame, key: str, name: str) -> DataFrame:
    """(key, pos, name): numbers of the batches whose rows begin at each key's first place and at all that pointers reach from it.

    `step` has a pointer (i, j) from each place to the next beginning of a batch; pointers of pointers, doubled, reach all of them.
    """
    tables, longest = [step], ends.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    while 1 << len(tables) <= longest:
        last = tables[-1]
        tables.append(stored(last.join(last.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").select("i", F.col("k").alias("j")), "jump"))
    begun = stored(ends.select(F.col("start").alias("i")), "begun")
    for t in reversed(tables):
        begun = stored(begun.unionByName(begun.join(t, "i").select(F.col("j").alias("i"))), "begun")
    marks = p.join(begun.select(F.col("i").alias("place"), F.lit(1).alias("mark")), "place", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    n = stored(prefix_sums(marks, "mark", "n"), "marks")
    first = n.join(small(ends.select(F.col("start").alias("place"), F.col(key).alias("__k"))), "place").select("__k", (F.col("n") - 1).alias("__n"))
    return n.join(small(stored(first, "firsts")), n[key].eqNullSafe(F.col("__k"))).select(key, "pos", (F.col("n") - F.col("__n")).cast("int").alias(name))


def _summed(rows: DataFrame, key: str, size: str, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with `place`, `size` and its prefix sum `upto`; each key's first and last place; the rows with these)."""
    p = stored(prefix_sums(placed(rows.select(key, "pos", *more, F.col(size).cast("long").alias("size")), [F.col(key), F.col("pos")]), "size", "upto"), "sums")
    ends = stored(p.groupBy(key).agg(F.min("place").alias("start"), F.max("place").alias("end")), "ends")
    return p, ends, p.join(small(ends.withColumnRenamed(key, "__k")), p[key].eqNullSafe(F.col("__k"))).drop("__k")


def jumps(rows: DataFrame, key: str, size: str, room: Column, most: int | None, first_room: int, first_most: int | None, name: str = "batch") -> DataFrame:
    """(key, pos, name): greedy batches of rows (key, pos, size) of any length, over many tasks.

    A batch ends before the row that makes it greater than its room or longer than `most`; a key's first batch has its own
    limits. Where the batch that begins at a row ends doesn't depend on the batches before, so it is a pointer, found from
    prefix sums.
    """
    p, ends, q = _summed(rows, key, size)
    lead = F.col("place") == F.col("start")
    limit = F.col("upto") - F.col("size") + F.when(lead, F.lit(first_room)).otherwise(room)
    far = stored(_first_beyond(p, q.select(F.col("place").alias("i"), limit.alias("limit"))), "beyond")
    rest = F.col("end") + 1 - F.col("place")
    count = F.when(lead, F.coalesce(F.lit(first_most).cast("long"), rest)).otherwise(F.coalesce(F.lit(most).cast("long"), rest))
    j = F.least(F.greatest(F.coalesce(F.col("j"), F.col("end") + 1), F.col("place") + 1), F.col("place") + count)
    step = stored(q.join(far, F.col("place") == F.col("i"), "left").select(F.col("place").alias("i"), j.alias("j"), "end").where("j <= end").select("i", "j"), "jump")
    return _begun(p, ends, step, key, name)


def soft_jumps(rows: DataFrame, key: str, size: str, mark: str, most: int, name: str = "batch") -> DataFrame:
    """(key, pos, name): batches of rows (key, pos, mark, size) of any length, over many tasks, that end early where `mark` changes.

    A batch ends before the row that makes it greater than `most`, or greater than half of it if that row's mark isn't the
    one of the row before. So its end is the nearer of two places: the first beyond `most`, and the first change of the mark
    at or behind the first place beyond half.
    """
    p, ends, q = _summed(rows, key, size, mark)
    at = lambda k: (F.col("upto") - F.col("size") + k).alias("limit")
    full = stored(_first_beyond(p, q.select(F.col("place").alias("i"), at(most))), "beyond").withColumnRenamed("j", "full")
    half = stored(_first_beyond(p, q.select(F.col("place").alias("i"), at(most // 2))), "beyond").select(F.col("i").alias("h"), F.col("j").alias("half"))
    own = q.join(full, F.col("place") == F.col("i"), "left").drop("i").join(half, F.col("place") == F.col("h"), "left").drop("h")
    own = own.select("place", "end", F.coalesce("full", F.col("end") + 1).alias("full"), F.greatest(F.coalesce("half", F.col("end") + 1), F.col("place") + 1).alias("half"))
    # the first change of the mark at or behind a place: within its piece, else the first one of the pieces behind
    before = p.select((F.col("place") + 1).alias("place"), F.struct(key, mark).alias("__b"))
    changes = p.join(before, "place", "left").select("place", (~F.struct(key, mark).eqNullSafe(F.col("__b"))).alias("new"), F.expr(f"(place - 1) div {PIECE}").alias("piece"))
    on = F.when(F.col("new"), F.col("place"))
    w = Window.partitionBy("piece").orderBy("place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # one row for each piece
    later = Window.orderBy("piece").rowsBetween(1, Window.unboundedFollowing)
    behind = stored(changes.groupBy("piece").agg(F.min(on).alias("c")).select("piece", F.min("c").over(later).alias("later")), "pieces")
    next_ = changes.withColumn("c", F.min(on).over(w)).join(small(behind), "piece").select(F.col("place").alias("half"), F.coalesce("c", "later").alias("soft"))
    j = F.greatest(F.least("full", F.coalesce("soft", F.col("end") + 1)), F.col("place") + 1)
    step = stored(own.join(next_, "half", "left").select(F.col("place").alias("i"), j.alias("j"), "end").where("j <= end").select("i", "j"), "jump")
    return _begun(p, ends, step, key, name)


def spend(rows: DataFrame, key: str, group: str, size: str, cap: int, most: int) -> DataFrame:
    """The rows (key, pos, group, size) that a walk with a cap for each group and `most` for the whole can take, and as many others at most as a bound allows.

    Rooms only shrink. So once a row of a size is refused for its group's cap, all later ones of that size and group are,
    and of each (group, size) only the first `cap div size` can be taken. What is left of a size is taken, refused for a
    group's cap, or behind a row that was refused for the whole, and then refused as well. At most `most div size` are taken;
    a group that refuses the size has spent more than `cap - size`, so there are at most `most div (cap - size + 1)` of
    these. Rows behind that many are refused whatever the walk does. The sum over sizes depends on `cap` and `most` alone.
    Rows are numbered by hashed pieces first, so no task has all rows of a common size.
    """
    at = F.col(size)
    some = rows.where(at.between(1, min(cap, most)))

    def first(r: DataFrame, by: list[str], n: Column, pieces: int) -> DataFrame:
        for salt in ([F.pmod(F.xxhash64("pos"), F.lit(pieces))], []) if pieces > 1 else ([],):
            r = r.withColumn("__r", F.row_number().over(Window.partitionBy(*by, *salt).orderBy("pos"))).where(F.col("__r") <= n).drop("__r")
        return r

    pieces = -(-(rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0) // PIECE)
    own = stored(first(some, [key, group, size], F.expr(f"{cap} div `{size}`"), pieces), "own")
    return first(own, [key, size], F.expr(f"{most} div `{size}` + ({most} div ({cap} - `{size}` + 1)) * ({cap} div `{size}`)"), pieces)


def split_long(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys that have few enough for one walk, and those of the others, if there are any."""
    many = stored(rows.groupBy(key).count().where(F.col("count") > LONG).select(F.col(key).alias("__k")), "long")
    if many.isEmpty():
        return rows, None
    here = rows[key].eqNullSafe(F.col("__k"))
    return rows.join(small(many), here, "left_anti"), rows.join(small(many), here, "left_semi")
