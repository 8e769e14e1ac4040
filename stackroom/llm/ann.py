"""Operator 9, approximate nearest neighbours: shifted space-filling curves.

Curves order directions: a vector's length doesn't enter its key, only its distance (recall on log-normal
lengths was measured as 0.94). Distinct vectors are projected to DIMS random orthonormal directions per curve, shifted and put on a grid
of BITS bits per direction; their Hilbert index orders them. All curves are range-partitioned and sorted by
(curve, key) in Spark and written once; ranks follow from the rows in each partition. The order is cut into
blocks, and each query meets its own block and those beside it, on every curve; only rows within WINDOW
ranks of it count. Per block the 10 nearest by exact distance are kept, and the blocks' lists merge.

WINDOW is measured: the exact nearest of SAMPLE queries are found among all vectors, and WINDOW is the least
that shows the share TARGET of them on some curve, at least LEAST rows. Clustered vectors thus get windows of
few rows whatever the table's size; vectors without structure (as in the test tables: isotropic in 64
dimensions) need a share of all rows, and get it. `share` sets a share instead. Blocks hold at most BLOCK rows,
so no task gathers more than a few blocks, whatever the window.

Equal vectors are one point on the curves and carry their k + 1 smallest ids, which is all that a list of
the k nearest can show of them; a vector held by a third of all rows is cut to those per task before the
shuffle.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those of another length than the most frequent one among the rows, or rows without id; repeated rows (same id and vector)
count once; equal distances go to the smaller id; an empty table gives an empty result; further columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, parts, ship, store

CURVES, DIMS, BITS, SEED = 12, 8, 5, 7
LEAST, BLOCK = 250, 4096
#: Queries whose exact neighbours set the window, and the share of these to be seen.
SAMPLE, TARGET = 64, 0.97
K, EVERY = 10, 100


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (int64) of integer points (n, m) with `bits` bits per coordinate; m * bits <= 62. Skilling's transpose form."""
    x = x.astype(np.int64).T.copy()
    m = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(m):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, m):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[m - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_frame(dim: int, curve: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (dim, m) and shift of a curve; both follow from the seed alone."""
    rng = np.random.default_rng([seed, curve])
    q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    return q[:, : min(dims, dim)], rng.random(min(dims, dim))


def keys_of(x: np.ndarray, curve: int, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Hilbert keys of the vectors' directions on one curve."""
    basis, shift = curve_frame(x.shape[1], curve, dims, seed)
    y = (x / np.sqrt((x * x).sum(1, keepdims=True))) @ basis * np.sqrt(x.shape[1])  # about standard normal if the vectors have no structure
    cell = np.clip((y + 4 + shift) / 9 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert(cell, bits)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1)


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a usable vector, as floats if it is given so (half the bytes to send), else as doubles."""
    kind = dict(rows.select(embedding).dtypes)[embedding]
    v = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    return v.where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def usual_length(v: DataFrame) -> int:
    """The most frequent length of the vectors, the greater one on ties."""
    found = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return found[0][0] if found else 0


def points_of(v: DataFrame, k: int) -> DataFrame:
    """(pid, v, ids): distinct vectors with their k + 1 smallest ids; the limit is applied before the shuffle."""
    first = v.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return store(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("pid"), "v", "ids"), "points")


def ranked(points: DataFrame, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """(curve, r, pid): each point's rank on every curve, from range partitions written once."""
    spark = points.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(keys_of(x, c, dims, bits, seed)), b.column("pid")], ["curve", "key", "pid"])

    keys = points.select("pid", "v").mapInArrow(run, "curve int, key long, pid long").repartitionByRange(parts(points), "curve", "key", "pid").sortWithinPartitions("curve", "key", "pid")
    placed = store(keys.select("curve", "pid", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "curves")
    # rows by partition and curve: as many as partitions and curves, whatever the data
    runs = sorted((r.asDict() for r in placed.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()), key=lambda r: (r["curve"], r["part"]))
    before, rows = {}, []
    for r in runs:
        rows.append((r["curve"], r["part"], before.get(r["curve"], 0) - r["first"]))
        before[r["curve"]] = before.get(r["curve"], 0) + r["n"]
    offsets = F.broadcast(spark.createDataFrame(rows, "curve int, part int, off long"))
    return placed.join(offsets, ["curve", "part"]).select("curve", (F.col("at") + F.col("off")).alias("r"), "pid")


def exact_nearest(points: DataFrame, some: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(qpid, pid): the k nearest points of each of a few (pid, v), but for itself; tasks keep the best they have met."""
    asked, x = np.array([p for p, _ in some], np.int64), np.array([v for _, v in some], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        for b in batches:
            if b.num_rows:
                y, pid = _matrix(b.column("v")), np.asarray(b.column("pid"))
                near = (y * y).sum(1) - 2 * (x @ y.T)  # but for a constant of the query
                for i, d in enumerate(near):
                    on = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                    on = on[pid[on] != asked[i]]
                    dd, pp = np.concatenate([best[i][0], d[on]]), np.concatenate([best[i][1], pid[on]])
                    by = np.lexsort((pp, dd))[:k]
                    best[i] = (dd[by], pp[by])
        n = [len(p) for _, p in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, n)), pa.array(np.concatenate([p for _, p in best])), pa.array(np.concatenate([d for d, _ in best]))], ["qpid", "pid", "d"])

    met = points.select("pid", "v").mapInArrow(run, "qpid long, pid long, d double")
    return met.withColumn("n", F.row_number().over(Window.partitionBy("qpid").orderBy("d", "pid"))).where(F.col("n") <= k).select("qpid", "pid")


def measured_window(points: DataFrame, ranks: DataFrame, asked: DataFrame, k: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    """The least distance in ranks that shows `target` of the exact neighbours of `sample` of the asked points on some curve."""
    some = asked.select("pid").distinct().orderBy(F.xxhash64("pid"), "pid").limit(sample)
    rows = [(r["pid"], r["v"]) for r in points.join(F.broadcast(some), "pid").select("pid", "v").collect()]
    if not rows:
        return 0
    true = store(exact_nearest(points, rows, k), "nearest")  # sample * k rows
    wanted = F.broadcast(true.select("pid").union(true.select("qpid")).distinct())
    r = store(ranks.join(wanted, "pid", "left_semi").select("curve", "r", "pid"), "places")
    j = true.join(r.withColumnRenamed("r", "r2"), "pid").join(r.select("curve", "r", F.col("pid").alias("qpid")), ["curve", "qpid"])
    far = sorted(x[0] for x in j.groupBy("qpid", "pid").agg(F.min(F.abs(F.col("r") - F.col("r2"))).alias("w")).select("w").collect())
    return far[min(len(far) - 1, int(np.ceil(target * len(far))))] if far else 0


def search(rows: DataFrame, queries: DataFrame, k: int = K, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, share: float | None = None, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """For each (vec_id, embedding) of `queries`, which are among `rows`: query_id, rank, vec_id, score."""
    ship(rows.sparkSession)
    v = usable(rows)
    fits = F.size("v") == usual_length(v)
    v = v.where(fits).dropDuplicates(["vec_id", "v"])
    points = points_of(v, k)
    asked = store(usable(queries).where(fits).dropDuplicates(["vec_id", "v"]).alias("q").join(points.alias("p"), F.expr("q.v = p.v")).select(F.col("q.vec_id").alias("query_id"), "p.pid"), "asked")
    n = points.count()
    r = store(ranked(points, curves, dims, bits, seed), "ranks")
    w = max(least, measured_window(points, r, asked, k) if share is None else int(share * n))
    block = max(1, min(BLOCK, w))
    vectors = points.select("pid", "v", F.element_at("ids", 1).alias("least_id")) if n else points.select("pid", "v", F.lit(0).cast("long").alias("least_id"))
    there = r.join(vectors, "pid").select("curve", (F.col("r") / block).cast("long").alias("block"), "r", "pid", "v", "least_id")
    mine = r.join(asked.select("pid").distinct(), "pid", "left_semi").join(vectors, "pid")
    mine = mine.select(F.col("curve").alias("qcurve"), F.explode(F.sequence((F.greatest(F.col("r") - w, F.lit(0)) / block).cast("long"), ((F.col("r") + w) / block).cast("long"))).alias("qblock"), F.col("r").alias("qr"), F.col("pid").alias("qpid"), F.col("v").alias("qv"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, lr, lp, li = _matrix(left["v"].combine_chunks()), *(np.asarray(left[c]) for c in ("r", "pid", "least_id"))
            sq = (x * x).sum(1)
            for a, qr, qp in zip(_matrix(right["qv"].combine_chunks()), right["qr"].to_pylist(), right["qpid"].to_pylist(), strict=True):
                at = np.flatnonzero(np.abs(lr - qr) <= w)
                if not len(at):
                    continue
                near = sq[at] + (a * a).sum() - 2 * (x[at] @ a)
                if len(at) > k + 1:
                    slack = 1e-9 * (1 + (a * a).sum())
                    at = at[near <= np.partition(near, k)[k] + slack]
                d = np.sqrt(((x[at] - a) ** 2).sum(1))
                best = np.lexsort((li[at], d))[: k + 1]
                out += [(qp, int(lp[at[i]]), float(d[i]), int(li[at[i]])) for i in best]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["qpid", "pid", "score", "least_id"])

    met = there.groupBy("curve", "block").cogroup(mine.groupBy("qcurve", "qblock")).applyInArrow(meet, "qpid long, pid long, score double, least_id long")
    best = met.dropDuplicates(["qpid", "pid"]).withColumn("n", F.row_number().over(Window.partitionBy("qpid").orderBy("score", "least_id"))).where(F.col("n") <= k + 1)
    lists = best.join(points.select("pid", "ids"), "pid").groupBy("qpid").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    each = asked.join(lists, F.expr("pid = qpid")).select("query_id", F.expr("slice(array_sort(filter(flatten(transform(near, x -> transform(x.ids, i -> struct(x.score as score, i as vec_id)))), y -> y.vec_id <> query_id)), 1, %d)" % k).alias("y"))
    return each.select("query_id", F.posexplode("y").alias("n", "y")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), "y.vec_id", "y.score")


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))
