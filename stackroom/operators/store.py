"""Table maintenance without a database: upserts, soft deletes, latest rows, cascades, as pure functions of tables.

A caller writes the result with the usual overwrite or append; the commit protocol makes each write atomic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`, which ends in a unique column."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_guarded(old: DataFrame, new: DataFrame, key: list[str], active: Column) -> DataFrame:
    """Append rows of `new` whose key has no active row."""
    return old.unionByName(new.join(old.where(active).select(*key), key, "left_anti"))


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, foreign), foreign, "left_anti")


def soft_delete(rows: DataFrame, hit: Column, now: Column, column: str = "deleted_at") -> DataFrame:
    """Sets the mark where it isn't set, so a second call changes nothing."""
    return rows.withColumn(column, F.when(hit & F.col(column).isNull(), now).otherwise(F.col(column)))


def update(rows: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """New values that aren't null replace the old ones of the rows hit."""
    for k, v in values.items():
        rows = rows.withColumn(k, F.when(hit, F.coalesce(v, F.col(k))).otherwise(F.col(k)))
    return rows


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Parents with their ordered children as an array; empty where there are none."""
    c = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[x for x in children.columns if x not in (key, *order)]))).alias(name))
    kind = dict(c.dtypes)[name]
    return parents.join(c, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def strict_sum(c: Column) -> Column:
    """The sum if every row has a value, else null."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def ledger(calls: DataFrame) -> DataFrame:
    """One row: calls, failures, known tokens, whether all reported, and calls by operation."""
    by = calls.groupBy("operation").agg(F.count("*").alias("n"))
    total = calls.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.every(F.col("tokens").isNotNull()).alias("all_reported"))
    return total.join(F.broadcast(by.agg(F.array_sort(F.collect_list(F.struct("operation", "n"))).alias("by_operation"))))


def compatible(identity: dict[str, object], usable: Column) -> Column:
    """May a stored artifact answer for this document now: it is usable and every part of its identity is the asked one."""
    out = F.coalesce(usable, F.lit(False))
    for k, v in identity.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def one(rows: DataFrame, hit: Column) -> DataFrame:
    """The row that is asked for; an error if there is none."""
    found = rows.where(hit)
    if found.isEmpty():
        raise LookupError("no such row")
    return found
