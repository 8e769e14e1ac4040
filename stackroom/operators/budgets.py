"""Ordered folds with budgets: greedy batches, partitions, prefix and skip budgets.

The folds depend on order, so each is a walk over one document's sorted rows with a state of fixed size; batches of
documents too long for one task are found by pointers from row to row, and a skip budget walks only the rows of such a
document that can be taken, whose number has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold, jumps, soft_jumps, spend, split_long

LEAD_ROWS, LEAD_CHARS, MOST_ROWS, MOST_CHARS = 3, 1500, 15, 5000


def _batch() -> dict:
    return {"batch": 0, "n": 0, "size": 0, "page": None}


def greedy_batches(rows: DataFrame, key: str = "doc") -> DataFrame:
    """(key, pos, batch): rows (key, pos, chars) in batches by count and characters; the first one is smaller."""

    def step(s: dict, chars: int) -> int:
        most, room = (LEAD_ROWS, LEAD_CHARS) if s["batch"] == 1 else (MOST_ROWS, MOST_CHARS)
        if not s["batch"] or s["n"] >= most or s["size"] + chars > room:
            s.update(batch=s["batch"] + 1, n=0, size=0)
        s["n"] += 1
        s["size"] += chars
        return s["batch"]

    short, long = split_long(rows, key)
    out = fold(short, key, ["pos"], ["chars"], _batch, step, "batch", "int")
    return out if long is None else out.unionByName(jumps(long, key, "chars", F.lit(MOST_CHARS), MOST_ROWS, LEAD_CHARS, LEAD_ROWS))


def token_chunks(rows: DataFrame, allowance: int, least: int = 400, charged: bool = True, key: str = "doc") -> DataFrame:
    """(key, pos, batch): rows (key, pos, tokens) in chunks of at most `allowance`; the first starts with all but `least` used."""

    def step(s: dict, tokens: int) -> int:
        if not s["batch"]:
            s.update(batch=1, size=allowance - least if charged else 0)
        elif s["size"] + tokens > allowance:
            s.update(batch=s["batch"] + 1, size=0)
        s["size"] += tokens
        return s["batch"]

    short, long = split_long(rows, key)
    out = fold(short, key, ["pos"], ["tokens"], _batch, step, "batch", "int")
    return out if long is None else out.unionByName(jumps(long, key, "tokens", F.lit(allowance), None, least if charged else allowance, None))


def page_partitions(rows: DataFrame, most: int = 1200, key: str = "doc") -> DataFrame:
    """(key, pos, batch): rows (key, pos, page, tokens); a page change ends a partition that is more than half full."""

    def step(s: dict, page: int, tokens: int) -> int:
        after = s["size"] + tokens
        if not s["batch"] or after > most or (page != s["page"] and after > most // 2):
            s.update(batch=s["batch"] + 1, size=0)
        s["size"] += tokens
        s["page"] = page
        return s["batch"]

    short, long = split_long(rows, key)
    out = fold(short, key, ["pos"], ["page", "tokens"], _batch, step, "batch", "int")
    return out if long is None else out.unionByName(soft_jumps(long, key, "tokens", "page", most))


def skip_budget(rows: DataFrame, most: int = 24000, share: float = 0.3, key: str = "doc") -> DataFrame:
    """(key, pos): rows (key, pos, section, chars) taken in order if both the section's share and the whole still fit."""
    cap = max(int(most * share), 1000)

    def step(s: dict, section: object, chars: int) -> bool | None:
        used = s["spent"].get(section, 0) + chars
        if used > cap or s["total"] + chars > most:
            return None
        s["spent"][section] = used
        s["total"] += chars
        return True

    short, long = split_long(rows, key)
    none = None
    if long is not None:
        # rows without characters always fit; of the others a walk meets a bounded number
        none = long.where(F.col("chars") == 0).select(key, "pos")
        left = spend(long, key, "section", "chars", cap, most)
        short = short.select(key, "pos", "section", "chars").unionByName(left.select(key, "pos", "section", "chars"))
    out = fold(short, key, ["pos"], ["section", "chars"], lambda: {"total": 0, "spent": {}}, step, "took", "boolean").select(key, "pos")
    return out if none is None else out.unionByName(none)


def prefix_budget(rows: DataFrame, cost: Column, room: int, key: str = "doc") -> DataFrame:
    """Rows in order while the cost of the prefix fits, up to the first that doesn't; `cost` is a window-ready sum over the prefix."""
    w = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("cost", cost).withColumn("over", F.max(F.col("cost") > room).over(w)).where("not over").drop("over")


def char_window(rows: DataFrame, radius: int = 800, key: str = "doc") -> DataFrame:
    """(key, pos, lo, hi): for each row the rows within `radius` characters before and after it, rows counted whole."""
    w = Window.partitionBy(key).orderBy("pos")
    r = rows.withColumn("start", F.coalesce(F.sum(F.col("chars") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = Window.partitionBy(key).orderBy("start").rangeBetween(-radius, radius)
    return r.withColumn("lo", F.min("pos").over(span)).withColumn("hi", F.max("pos").over(span)).select(key, "pos", "lo", "hi")
