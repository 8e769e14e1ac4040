"""Trees of JSON as VARIANT values, walked level by level: what a level holds is a table, however deep or wide a tree is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import stored


def get(node: Column | str, path: str, kind: str) -> Column:
    """The value at a path of a variant, null if it isn't there or of another kind."""
    return F.try_variant_get(F.col(node) if isinstance(node, str) else node, path, kind)


def kind_of(node: Column | str) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ...: the outer kind of a variant."""
    return F.regexp_extract(F.schema_of_variant(node), "^([A-Z]+)", 1)


def items(rows: DataFrame, node: Column, at: str = "at", item: str = "item") -> DataFrame:
    """A row for each element of an array, with its place; none for anything else."""
    return rows.select("*", F.posexplode_outer(get(node, "$", "array<variant>")).alias(at, item)).where(F.col(at).isNotNull())


def expanded(rows: DataFrame, node: str, path: str, inner: Callable[[Column], Column], below: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows whose `node` isn't `inner`; each inner row is replaced by those that `below` makes of it, again and again.

    `below` gives rows of the same columns, with `path` (array<int>) one place longer.
    """
    out = rows.where(~inner(F.col(node)))
    left = rows.where(inner(F.col(node)))
    while True:
        left = stored(left.withColumn(node, F.to_json(node)), "tree").withColumn(node, F.parse_json(node))
        if left.isEmpty():
            return out
        level = below(left)
        out = out.unionByName(level.where(~inner(F.col(node))))
        left = level.where(inner(F.col(node)))


def leaves(raw: DataFrame, column: str = "value") -> DataFrame:
    """(id, key, leaf): every value of a JSON text that is no object or array, with its name if an object holds it. What is no JSON has none."""
    rows = raw.select("id", F.lit(None).cast("string").alias("key"), F.try_parse_json(column).alias("leaf")).where("leaf is not null")
    out = None
    while True:
        rows = rows.withColumn("kind", kind_of("leaf"))
        flat = rows.where("kind not in ('OBJECT', 'ARRAY')").select("id", "key", "leaf")
        out = flat if out is None else out.unionByName(flat)
        inner = stored(rows.where("kind in ('OBJECT', 'ARRAY')").select("id", F.to_json("leaf").alias("leaf")), "tree").withColumn("leaf", F.parse_json("leaf"))
        if inner.isEmpty():
            return out
        each = raw.sparkSession.tvf.variant_explode(F.col("leaf").outer())
        rows = inner.lateralJoin(each).select("id", "key", F.col("value").alias("leaf"))
