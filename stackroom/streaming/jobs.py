"""Structured Streaming: chunked answers, ledgers, progress and resumable jobs.

State is kept by key, so it spreads over the cluster; sinks are idempotent per key, so a batch that is run
again after a failure changes nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import linking
from ..operators.shared import exists, small
from ..shipping import ship

OBJECTS = "stream_id string, n int, value string"
#: The state store that typed state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BRACKETS, _IN_STRING = re.compile(r'[][{}"]'), re.compile(r'["\\]')


@dataclass
class Scan:
    """Where a scan of JSON text stands: the brackets open, whether inside a string and behind its backslash, and the object being read.

    An object counts if an array holds it directly and no object that is being read itself; brackets in strings don't count.
    """

    open: str = ""
    quoted: bool = False
    escaped: bool = False
    held: str = ""
    depth: int = -1  # of the array that holds the object being read

    def feed(self, text: str) -> list[str]:
        """The objects that end in this text. What an object's brackets enclose but isn't JSON is passed over."""
        out, at, begin = [], 0, 0
        while at < len(text):
            if self.escaped:
                self.escaped, at = False, at + 1
                continue
            m = (_IN_STRING if self.quoted else _BRACKETS).search(text, at)
            if m is None:
                break
            c, at = m[0], m.end()
            if c == "\\":
                self.escaped = True
            elif c == '"':
                self.quoted = not self.quoted
            elif c in "[{":
                if c == "{" and self.depth < 0 and self.open.endswith("["):
                    self.depth, begin = len(self.open), at - 1
                self.open += c
            else:
                self.open = self.open[:-1]
                if 0 <= self.depth == len(self.open):
                    piece, self.held, self.depth = self.held + text[begin:at], "", -1
                    try:
                        json.loads(piece)
                    except ValueError:
                        continue
                    out.append(piece)
        if self.depth >= 0:
            self.held += text[begin:]
        return out


class Objects(StatefulProcessor):
    """Typed state of each stream: the scan, and by their numbers the chunks that came before they were due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scan = handle.getValueState("scan", "due int, n int, open string, quoted boolean, escaped boolean, held string, depth int")
        self.early = handle.getMapState("early", "seq int", "chunk string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, n, *state = self.scan.get() if self.scan.exists() else (0, 0, *astuple(Scan()))
        scan, begun, found = Scan(*state), due, []
        for f in rows:
            for seq, chunk in zip(f["seq"].tolist(), f["chunk"].tolist(), strict=True):
                if seq == due:
                    found += scan.feed(chunk or "")
                    due += 1
                elif seq > due:
                    self.early.updateValue((int(seq),), (chunk or "",))
        while self.early.containsKey((due,)):
            found += scan.feed(self.early.getValue((due,))[0])
            due += 1
        for seq in [k[0] for k in self.early.keys() if begun <= k[0] < due]:
            self.early.removeKey((seq,))
        self.scan.update((due, n + len(found), *astuple(scan)))
        if found:
            yield pd.DataFrame([(key[0], n + i, v) for i, v in enumerate(found)], columns=["stream_id", "n", "value"])

    def close(self) -> None:
        pass


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep typed state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def objects(chunks: DataFrame) -> DataFrame:
    """Streaming (stream_id, seq from 0, chunk) -> each object of any array as soon as it is complete; chunks may come in any order and more than once.

    The query is to be started under `typed_state`.
    """
    ship(chunks.sparkSession)
    return chunks.groupBy("stream_id").transformWithStateInPandas(Objects(), OBJECTS, "Append", "None")


def objects_batch(chunks: DataFrame) -> DataFrame:
    """The same from a table of chunks: streams are dealt and sorted, and a worker walks them with one scan in memory."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, due, n, scan = None, False, 0, 0, Scan()
        for b in batches:
            out = []
            for k, seq, chunk in zip(*(b.column(c).to_pylist() for c in ("stream_id", "seq", "chunk")), strict=True):
                if not begun or k != now:
                    now, begun, due, n, scan = k, True, 0, 0, Scan()
                if seq == due:
                    due += 1
                    for v in scan.feed(chunk or ""):
                        out.append((k, n, v))
                        n += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["stream_id", "n", "value"])

    return chunks.select("stream_id", "seq", "chunk").repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, OBJECTS)


def landed(rows: DataFrame, path: str, state: str, seconds: float = 1.0, once: bool = False):
    """A started query that commits what has come, at most once in `seconds`; with `once`, all there is, and then ends."""
    when = {"availableNow": True} if once else {"processingTime": f"{int(seconds * 1000)} milliseconds"}
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(**when).start()


def ledger_stream(events: DataFrame) -> DataFrame:
    """Running counts and sums by operation of a stream of calls."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").count()


def progress(events: DataFrame) -> DataFrame:
    """The latest value of each task."""
    return events.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))


class LatestWithin(StatefulProcessor):
    """The latest value of each task, forgotten when `idle` has passed in event time since; late rows are counted, not lost silently."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, value double, due long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        event, value, due, late = self.last.get() if self.last.exists() else (-1, None, 0, 0)
        mark, before = timerValues.getCurrentWatermarkInMs(), due
        for f in rows:
            for e, v, ms in zip(f["event_id"].tolist(), f["value"].tolist(), f["ms"].tolist(), strict=True):
                if ms < mark:
                    late += 1
                    continue
                due = max(due, ms + self.idle)
                if e > event:
                    event, value = e, v
        if due != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        if due or late:
            self.last.update((event, value, due, late))
        yield pd.DataFrame([(key[0], value, late, False)], columns=["user_id", "value", "late", "expired"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, value, _, late = self.last.get() if self.last.exists() else (0, None, 0, 0)
        self.last.clear()
        yield pd.DataFrame([(key[0], value, late, True)], columns=["user_id", "value", "late", "expired"])

    def close(self) -> None:
        pass


def progress_within(events: DataFrame, idle_ms: int, late: str = "5 minutes") -> DataFrame:
    """(user_id, value, late, expired): updates of each task's latest value from (user_id, event_id, ts, value), and a last row when its state goes."""
    ship(events.sparkSession)
    rows = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(LatestWithin(idle_ms), "user_id long, value double, late long, expired boolean", "Update", "EventTime")


def resumable(spark, planned: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: does only rows of the batch that are planned and not in the table at `path`, and appends them."""

    def run(batch: DataFrame, epoch: int) -> None:
        todo = batch.join(planned.select(key), key, "left_semi")
        if exists(spark, path):
            todo = todo.join(spark.read.parquet(path).select(key), key, "left_anti")
        work(todo.dropDuplicates([key])).write.mode("append").parquet(path)

    return run


def newest(rows: DataFrame, key: str = "id") -> DataFrame:
    """The row of each key that was written under the newest version of the glossary."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r")).select(key, "r.*")


def disagreeing(texts: DataFrame, done: DataFrame, terms: DataFrame, key: str = "id") -> DataFrame:
    """(key): rows done before a term was known whose text holds the term and whose result lacks its target.

    `texts` (key, text), `done` (key, done, version), `terms` (source, target, version); of a term, its newest version counts.
    """
    now = terms.groupBy("source").agg(F.max_by("target", "version").alias("target"), F.max("version").alias("since"))
    met = linking.occurrences(texts, now, [key]).join(small(now.withColumnRenamed("source", "term")), "term")
    old = met.join(newest(done, key), key).where(F.col("version") < F.col("since"))
    return old.where(~F.contains(F.lower("done"), F.lower("target"))).select(key).distinct()


def late_terms(spark, texts: DataFrame, path: str, work: Callable[[DataFrame, int], DataFrame], key: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over a stream of (source, target, version): rows at `path` that disagree with the terms of a batch are done again, once.

    `work(rows, version)` gives (key, done); results are appended under the batch's newest version, so a batch that is run again finds nothing to do.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        version = batch.agg(F.max("version")).first()[0]
        if version is None or not exists(spark, path):
            return
        todo = texts.join(disagreeing(texts, spark.read.parquet(path), batch, key), key, "left_semi")
        work(todo, version).withColumn("version", F.lit(version).cast("int")).write.mode("append").parquet(path)

    return run
