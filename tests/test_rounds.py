"""Operators that work in rounds or commits, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from stackroom.functions import calls
from stackroom.operators import budgets, commits, folds, search, selection


def test_suppression_is_that_of_the_walk(spark):
    rng = random.Random(3)
    boxes = [(p, i, rng.choice([0.5, 0.7, 0.9]), *(round(rng.randrange(8) * 0.3 - 1, 1) for _ in range(2)), 10.0, 10.0 + rng.randrange(3) * 0.4) for p in range(6) for i in range(60)]
    boxes += [(9, i, 1.0 - i / 1000, i * 0.4, 0.0, i * 0.4 + 9, 1.0) for i in range(40)] + [(10, 1, None, 0.0, 0.0, 1.0, 1.0)]
    want = set()
    for p in {b[0] for b in boxes}:
        kept = []
        for b in sorted((b for b in boxes if b[0] == p), key=lambda b: (-(b[2] or 0), b[1])):
            if not any(all(abs(x - y) <= 0.5 for x, y in zip(b[3:], k[3:], strict=True)) for k in kept):
                kept.append(b)
        want |= {(p, b[1]) for b in kept}
    t = spark.createDataFrame(boxes, "page int, id int, score double, x0 double, y0 double, x1 double, y1 double")
    log = []
    assert {(r["page"], r["id"]) for r in selection.drop_duplicates(t, log=log).collect()} == want
    assert len(log) == 20 and log[0] > log[-1]  # the chain of forty takes a round for every second box
    assert selection.drop_duplicates(t.where("false")).count() == 0


def test_commits_are_whole_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert commits.read(spark, root) == {} and commits.append(spark, root, {"notes": rows(1), "targets": rows(10)}) == 0
    commits.write_data(root, {"notes": rows(2)})  # a writer that dies before its manifest
    now = commits.read(spark, root)
    assert ids(now["notes"]) == [1] and ids(now["targets"]) == [10]
    # two writers take the newest version; one wins, and an append goes on from it
    version, folders = commits.manifest(spark, root)
    commits.publish(spark, root, version + 1, folders)
    with pytest.raises(commits.Conflict):
        commits.publish(spark, root, version + 1, {})
    assert commits.append(spark, root, {"notes": rows(3)}) == 2
    assert ids(commits.read(spark, root)["notes"]) == [1, 3] and ids(commits.read(spark, root, 0)["notes"]) == [1]

    def change(tables):
        commits.append(spark, root, {"notes": rows(4)})
        return {"notes": tables["notes"].where("id > 1")}

    with pytest.raises(commits.Conflict):
        commits.rewrite(spark, root, change)
    assert commits.rewrite(spark, root, lambda t: {"notes": t["notes"].where("id > 1")}) == 4
    now = commits.read(spark, root)
    assert ids(now["notes"]) == [3, 4] and ids(now["targets"]) == [10]
    # a manifest whose writer died while it wrote is none
    p, fs = commits._fs(spark, f"{root}/manifest/5")
    fs.create(p, False).close()
    assert commits.manifest(spark, root)[0] == 4 and commits.append(spark, root, {"notes": rows(5)}) == 6
    assert commits.vacuum(spark, root) >= 3 and ids(commits.read(spark, root)["notes"]) == [3, 4, 5]


def test_blocks_that_cannot_reach_the_best_stay_closed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BITS", 4)
    monkeypatch.setattr(search, "FIRST", 2)
    rng = random.Random(1)
    text = lambda i: " ".join(["common"] * (9 if i in (70, 71, 500) else rng.randrange(1, 3)) + ["rare"] * (i % 97 == 0) + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(3, 30))])
    chunks = spark.createDataFrame([(i - 50, f"title {i % 5}", text(i)) for i in range(900)], "chunk_id long, title string, text string")
    path = f"file://{tmp_path}/index"
    search.ensure_index(spark, path, chunks, "h", "1")
    v = spark.createDataFrame([("one", "common"), ("two", "common"), ("two", "w3"), ("few", "rare"), ("none", "absent"), ("one", "common")], "variant string, word string")
    same = lambda df: sorted((r["variant"], r["chunk_id"], round(r["score"], 9), r["r"]) for r in df.collect())
    for k in (1, 3, 20):
        assert same(search.block_max_top_k(spark, path, v, k)) == same(search.top_k(search.bm25(chunks, v), k))
    some = chunks.where("chunk_id % 3 = 0")
    assert same(search.block_max_top_k(spark, path, v, 5, some)) == same(search.top_k(search.bm25(chunks, v, F.col("chunk_id") % 3 == 0), 5))
    bounds, _ = search.block_bounds(*search.read_index(spark, path), v.where("variant = 'one'"))
    blocks = sorted((r["bound"] for r in bounds.collect()), reverse=True)
    third = -same(search.block_max_top_k(spark, path, v.where("variant = 'one'"), 3))[-1][2]
    assert len(blocks) == 58 and sum(b >= third for b in blocks) < 6  # of 58 blocks a few are read
    monkeypatch.setattr(search, "WORDS", 1)
    assert same(search.block_max_top_k(spark, path, v, 3)) == same(search.top_k(search.bm25(chunks, v), 3))


def test_batches_by_jumps_are_those_of_the_walk(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(d, i, rng.choice([0, 10, 400, 900, 6000])) for d, n in (("a", 700), ("b", 1), ("c", 40), (None, 90)) for i in range(n)] + [("z", i, 0) for i in range(300)]
    t = spark.createDataFrame(rows, "doc string, pos int, chars int")
    tokens = t.withColumnRenamed("chars", "tokens")
    same = lambda df: sorted(map(tuple, df.collect()), key=str)
    walk = [same(budgets.greedy_batches(t)), same(budgets.token_chunks(tokens, 2000, 400)), same(budgets.token_chunks(tokens, 2000, charged=False))]
    monkeypatch.setattr(folds, "LONG", 39)
    monkeypatch.setattr(folds, "PIECE", 64)
    assert [same(budgets.greedy_batches(t)), same(budgets.token_chunks(tokens, 2000, 400)), same(budgets.token_chunks(tokens, 2000, charged=False))] == walk


def test_partitions_and_skips_of_long_documents_are_those_of_the_walk(spark, monkeypatch):
    rng = random.Random(8)
    rows, page = [], 0
    for d, n in (("a", 700), ("b", 1), ("c", 40), (None, 90)):
        for i in range(n):
            page += rng.random() < 0.06
            rows.append((d, i, None if page % 7 == 0 else page, rng.choice([0, 1, 90, 300, 610, 1300]), rng.choice(["x", "y", None, f"s{i % 50}"])))
    rows += [("one page", i, 1, 100, "x") for i in range(200)] + [("pages", i, i, 100, f"s{i}") for i in range(200)] + [("empty", i, 1, 0, "x") for i in range(200)]
    t = spark.createDataFrame(rows, "doc string, pos int, page int, tokens int, section string")
    chars = t.withColumnRenamed("tokens", "chars")
    same = lambda df: sorted(map(tuple, df.collect()), key=str)
    runs = lambda: [same(budgets.page_partitions(t)), same(budgets.page_partitions(t, 5)), *(same(budgets.skip_budget(chars, m, s)) for m, s in ((24000, 0.3), (900, 0.9)))]
    walk = runs()
    monkeypatch.setattr(folds, "LONG", 39)
    monkeypatch.setattr(folds, "PIECE", 64)
    assert runs() == walk
    # a common size: of ten thousand rows the walk meets what the two limits allow
    many = spark.range(10_000).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), F.lit("x").alias("section"), F.lit(500).alias("chars"))
    assert folds.spend(many, "doc", "section", "chars", 1000, 3000).count() == 2


def test_ledger_of_a_stream(spark, tmp_path):
    def provider(text):
        if "bad" in text:
            raise ValueError
        return "ok"

    for i, texts in enumerate([["a", "bad"], ["b", "c", None]]):
        spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    src = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    ledger = calls.StreamLedger(spark, f"file://{tmp_path}/ledger")
    spark.streams.addListener(ledger)
    try:
        made = ledger.watch(calls.with_ledger(src, provider, "translate"), "translate")
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(60):
            got = list((tmp_path / "ledger").glob("*.json")) if (tmp_path / "ledger").exists() else []
            if len(got) >= 2:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(ledger)
    rows = spark.read.schema("operation string, batch long, calls long, failed long").json(f"{tmp_path}/ledger").collect()
    assert sum(r["calls"] for r in rows) == 5 and sum(r["failed"] for r in rows) == 1 and {r["operation"] for r in rows} == {"translate"} and len({r["batch"] for r in rows}) == len(rows)
