"""Calls to a model with rules around them: retries by kind of failure, ledgers, chunks, guards."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.shared import write_file
from ..shipping import ship
from . import text as T
from .providers import Provider, call


class CallError(Exception):
    """A failed call; `kind` says whether and how often it is worth another one."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


#: Calls in all that a kind of failure allows; others aren't tried again. Fixed values.
CALLS = {"rate_limit": 3, "server": 2, "timeout": 2}
PAUSES = (1.0, 2.0)
GROWN, REPAIRS = 2, 1


def _called(provider: Callable[[str, int], str], prompt: str, allowance: int) -> tuple[dict | None, str]:
    """An object, or the kind of failure."""
    try:
        found = json.loads(provider(prompt, allowance))
    except CallError as e:
        return None, e.kind
    except ValueError:
        return None, "invalid"
    return (found, "") if isinstance(found, dict) else (None, "invalid")


def _another(kind: str, calls: int, failures: Counter, allowance: int, room: int) -> tuple[int, float] | None:
    """(allowance, pause) of one more call, if this kind of failure is worth it after so many."""
    if kind == "invalid":
        return (allowance, 0.0) if failures[kind] <= REPAIRS else None
    if kind == "truncated":
        more = min(2 * allowance, room)
        return (more, 0.0) if failures[kind] <= GROWN and more > allowance else None
    return (allowance, PAUSES[min(calls, len(PAUSES)) - 1]) if calls < CALLS.get(kind, 0) else None


def request_json(provider: Callable[[str, int], str], prompt: str, input_tokens: int, allowance: int, budget: int, pause: Callable[[float], None] = time.sleep) -> tuple[dict | None, str, int]:
    """(object, kind of failure, calls): a JSON object from a provider of (prompt, allowance).

    Failures are tried again as CALLS says; a truncated answer twice, with the allowance doubled within the
    budget; an answer that is no object once, with the problem told. What remains is the failure's kind.
    """
    if input_tokens + allowance > budget:
        return None, "budget", 0
    asked, failures = prompt, Counter()
    for calls in count(1):
        found, kind = _called(provider, asked, allowance)
        if not kind:
            break
        failures[kind] += 1
        step = _another(kind, calls, failures, allowance, budget - input_tokens)
        if step is None:
            break
        allowance, wait = step
        if kind == "invalid":
            asked = f"{prompt}\nYour answer was not a JSON object."
        if wait:
            pause(wait)
    return found, kind, calls


OUTCOME = "struct<value:string,failure:string,calls:int>"


def requests(rows: DataFrame, provider: Callable[[str, int], str], allowance: int, budget: int, column: str = "prompt", pause: float = 1.0) -> DataFrame:
    """Adds `outcome`: each prompt's object as text, the kind of failure, and the calls made."""
    ship(rows.sparkSession)
    kind = pa.struct([("value", pa.string()), ("failure", pa.string()), ("calls", pa.int32())])

    def run(prompts: pa.Array, tokens: pa.Array) -> pa.Array:
        out = []
        for p, n in zip(prompts.to_pylist(), tokens.to_pylist(), strict=True):
            got = request_json(provider, p or "", n or 0, allowance, budget, lambda s: time.sleep(s * pause))
            out.append({"value": None if got[0] is None else json.dumps(got[0], ensure_ascii=False, sort_keys=True), "failure": got[1], "calls": got[2]})
        return pa.array(out, kind)

    return rows.withColumn("outcome", F.arrow_udf(run, OUTCOME).asNondeterministic()(F.col(column), T.estimate_tokens(F.col(column)).cast("int")))


def with_ledger(rows: DataFrame, provider: Provider, operation: str, column: str = "text") -> DataFrame:
    """Adds reply, ok and error of each call; a failed call has its error's kind and no reply. See `ledger_rows`."""
    ship(rows.sparkSession)
    kind = pa.struct([("reply", pa.string()), ("ok", pa.bool_()), ("error", pa.string())])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append({"reply": provider(t or ""), "ok": True, "error": None})
            except Exception as e:  # noqa: BLE001 - every outcome is a row of the ledger
                out.append({"reply": None, "ok": False, "error": getattr(e, "kind", type(e).__name__)})
        return pa.array(out, kind)

    made = rows.withColumn("__call", F.arrow_udf(run, "struct<reply:string,ok:boolean,error:string>").asNondeterministic()(F.col(column)))
    return made.select(*rows.columns, F.lit(operation).alias("operation"), "__call.reply", "__call.ok", "__call.error")


def ledger_rows(calls: DataFrame, column: str = "text") -> DataFrame:
    """One ledger row per outcome: (operation, ok, input_tokens, output_tokens, error); a failed call has no usage."""
    usage = lambda c: F.when(F.col("ok"), T.estimate_tokens(F.coalesce(c, F.lit("")))).cast("long")
    return calls.select("operation", "ok", usage(F.col(column)).alias("input_tokens"), usage(F.col("reply")).alias("output_tokens"), "error")


TOTALS = ["calls", "failed", "input_tokens", "output_tokens"]


def _totals(calls: DataFrame, column: str, operation: str, name: str | Observation) -> DataFrame:
    known = {c: F.coalesce(F.sum(F.col(f"__ledger.{c}")), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")}
    # the ledger's columns stand beside the rows only while they are counted
    beside = calls.withColumn("__ledger", F.struct(F.col("ok"), *[F.when(F.col("ok"), T.estimate_tokens(F.coalesce(F.col(c), F.lit("")))).cast("long").alias(n) for c, n in ((column, "input_tokens"), ("reply", "output_tokens"))]))
    return beside.observe(name, F.count("*").alias("calls"), F.count_if(~F.col("__ledger.ok")).alias("failed"), *known.values()).drop("__ledger")


def observed(calls: DataFrame, operation: str, column: str = "text") -> tuple[DataFrame, Callable[[], dict]]:
    """The calls of `with_ledger`, and what gives their one ledger row of totals after an action has run over all of them.

    The totals are counted while the rows pass, so calls aren't made again for them.
    """
    seen = Observation(f"ledger-{operation}-{uuid.uuid4().hex}")
    out = _totals(calls, column, operation, seen)
    return out, lambda: {"operation": operation, **{c: seen.get[c] for c in TOTALS}}


class StreamLedger(StreamingQueryListener):
    """One ledger row for each batch and operation of observed streams, as a file of JSON in a folder; a batch that is told again has the same file."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def watch(self, calls: DataFrame, operation: str, column: str = "text") -> DataFrame:
        return _totals(calls, column, operation, f"ledger-{operation}")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            if name.startswith("ledger-"):
                made = {"operation": name.removeprefix("ledger-"), "batch": p.batchId, **{c: row[c] for c in TOTALS}}
                write_file(self.spark, f"{self.folder}/{p.id}-{p.batchId}-{made['operation']}.json", json.dumps(made).encode())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def guarded(rows: DataFrame, provider: Provider, column: str = "text", into: str = "translated") -> DataFrame:
    """Formulas are hidden behind numbered marks, each reply must hold all marks exactly, one repair is tried, and what fails keeps its source."""
    import re

    ship(rows.sparkSession)
    formula, mark = re.compile(r"\$[^$\n]+\$"), re.compile("⟦m([0-9]+)⟧")

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            if t is None:
                out.append(None)
                continue
            held: list[str] = []

            def hide(m: re.Match, held: list[str] = held) -> str:
                held.append(m[0])
                return f"⟦m{len(held)}⟧"

            bare = formula.sub(hide, t)
            want = sorted(range(1, len(held) + 1))
            for _ in range(2):
                reply = provider(bare)
                if sorted(int(x) for x in mark.findall(reply)) == want:
                    out.append(mark.sub(lambda m, held=held: held[int(m[1]) - 1], reply))
                    break
            else:
                out.append(t)
        return pa.array(out, pa.string())

    return rows.withColumn(into, F.arrow_udf(run, "string").asNondeterministic()(F.col(column)))


def chunked(rows: DataFrame, provider: Provider, key: str = "key", column: str = "text", most: int = 8, limit: int = 120) -> DataFrame:
    """(key, relation): rows with a text are asked for in calls of at most `most`; of a reply's items only keys that were asked count, the last of each, of at most `limit` characters."""

    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = list(zip(b.column(key).to_pylist(), b.column(column).to_pylist(), strict=True))
            for i in range(0, len(items), most):
                some = items[i : i + most]
                try:
                    reply = json.loads(provider(json.dumps({"items": [{"key": k, "text": t} for k, t in some]})))
                except ValueError:
                    continue
                asked, found = {str(k) for k, _ in some}, {}
                for x in (reply.get("items") or []) if isinstance(reply, dict) else []:
                    if isinstance(x, dict) and isinstance(x.get("relation"), str) and str(x.get("key")) in asked and 0 < len(x["relation"].strip()) <= limit:
                        found[str(x["key"])] = x["relation"].strip()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()))], ["key", "relation"])

    return rows.where(F.trim(F.coalesce(column, F.lit(""))) != "").select(key, column).mapInArrow(run, "key string, relation string")


def extracted_terms(papers: DataFrame, provider: Provider, most: int = 100) -> DataFrame:
    """(doc, pos, source, target): one call for each paper (doc, text); terms that occur in it and aren't their own translation, first of each spelling."""
    r = call(papers.select("doc", "text"), provider)
    t = r.select("doc", "text", F.posexplode(F.from_json(T.json_object(F.col("reply")), "terms array<struct<source:string,target:string>>")["terms"]).alias("pos", "t"))
    t = t.select("doc", "text", "pos", T.squeeze(F.col("t.source")).alias("source"), T.squeeze(F.col("t.target")).alias("target"))
    t = t.where((F.col("source") != "") & (F.col("target") != "") & (F.length("source") <= 80) & (F.length("target") <= 80) & (F.lower("source") != F.lower("target")) & T.occurs(F.col("source"), F.col("text")))
    one = t.groupBy("doc", F.lower("source").alias("k")).agg(F.min(F.struct("pos", "source", "target")).alias("x"))
    g = one.groupBy("doc").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("x"))
    return g.select("doc", F.explode("x").alias("x")).select("doc", "x.pos", "x.source", "x.target")


def synthesis(papers: DataFrame, provider: Provider, required: list[str]) -> DataFrame:
    """(doc, status, points, repaired): one call for each paper, one more if its answer is no object; READY with a point of each required category."""
    ask = call(papers.select("doc", "text"), provider, "text", "r1")
    again = F.when(T.json_object(F.col("r1")).isNull(), F.concat("text", F.lit("\nReply with the JSON object only.")))
    both = call(ask.withColumn("again", again), provider, "again", "r2")
    obj = F.coalesce(T.json_object(F.col("r1")), T.json_object(F.col("r2")))
    points = F.filter(F.coalesce(F.from_json(obj, "points array<struct<category:string,text:string>>")["points"], F.array().cast("array<struct<category:string,text:string>>")), lambda p: F.trim(F.coalesce(p.text, F.lit(""))) != "")
    got = F.array_distinct(F.transform(points, lambda p: p.category))
    whole = F.size(F.array_except(T.strings(required), got)) == 0
    return both.select("doc", F.when(obj.isNull(), "FAILED").when(whole, "READY").otherwise("PARTIAL").alias("status"), F.size(points).alias("points"), F.col("again").isNotNull().alias("repaired"))
