"""Operator 1, license scans: an exact set-similarity join of text blocks with license templates.

A block is a run of 2 * STEP words that starts at a multiple of STEP, so every passage of up to STEP
words lies whole in a block. Template tokens are ordered by their frequency over all documents, rare
first; other tokens never match and stand behind them. A block holds a template when it has at least
o = ceil(threshold * |T|) of its distinct tokens. The join looks up each block's first |B| - o + 1
tokens among each template's first |T| - o + 1 (prefix filter), drops pairs with |B| < o (length filter)
or with too few tokens behind the match (positional filter), keeps a pair at its first common prefix
token only, and verifies the rest by intersection. Phrases are templates of threshold 1; an exact check
then finds the places where their words stand consecutively. A notice must also have its mark in a row in
the block, which tells rival licenses apart ("cc by nc 4 0" from "cc by sa 4 0").

The gate lower-cases by Unicode rules, which only lets more texts through; words compared are lower-cased in
A-Z alone.

All is DataFrame functions; the templates, a fixed parameter, are the only broadcast.

Defined cases: a null text is empty (0 words, no place, empty labels, score 0); repeated rows are scanned
row by row, also with null ids; a block may match several templates, alike or not, and has all their labels; a
very long text is scanned whole, as blocks; an empty table gives an empty table; the input's further columns aren't
read, so clashing names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

STEP = 64
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices as their licenses' texts give them, each of at most STEP words; a block with THRESHOLD of the distinct words has the label.
THRESHOLD = (4, 5)
#: Label and mark of each notice. The mark, words that must stand in a row, tells a license from its rivals, whose notices share all other words.
TEMPLATES = {
    "licensed under the apache license version 2 0": ("apache-2.0", "version 2 0"),
    "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0": ("apache-2.0", "license 2 0"),
    "this work is licensed under the gnu general public license version 2": ("gpl-2.0", "general public license version 2"),
    "this work is licensed under the gnu general public license version 3": ("gpl-3.0", "general public license version 3"),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": ("gpl-2.0-or-later", "either version 2"),
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": ("gpl-3.0-or-later", "either version 3"),
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": ("lgpl", "gnu lesser general public"),
    "licensed under cc by 4 0": ("cc-by-4.0", "cc by 4 0"),
    "licensed under cc by nc 4 0": ("cc-by-nc-4.0", "cc by nc 4 0"),
    "licensed under cc by sa 4 0": ("cc-by-sa-4.0", "cc by sa 4 0"),
    "licensed under cc by nd 4 0": ("cc-by-nd-4.0", "cc by nd 4 0"),
    "licensed under cc by nc sa 4 0": ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    "licensed under cc by nc nd 4 0": ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    "this work is licensed under a creative commons attribution 4 0 international license": ("cc-by-4.0", "attribution 4 0"),
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense": ("mit", "to deal in the software"),
    "released under the mit license all rights reserved": ("mit", "mit license"),
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": ("bsd", "source and binary forms"),
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": ("isc", "with or without fee"),
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at": ("mpl-2.0", "mozilla public license"),
    "this is free and unencumbered software released into the public domain": ("unlicense", "unencumbered software"),
}


def _templates(phrases: dict[str, str], templates: dict[str, tuple[str, str]]) -> list[dict]:
    out = []
    for base, some, (p, q) in ((True, {k: (v, k) for k, v in phrases.items()}, (1, 1)), (False, templates, THRESHOLD)):
        for text, (label, mark) in some.items():
            words = text.split()
            assert len(words) <= STEP
            tokens = list(dict.fromkeys(words))
            out.append({"base": base, "label": label, "mark": mark.split(), "tokens": tokens, "need": -(-p * len(tokens) // q)})
    return out


def _lit(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[tuple[str, int]]:
    """The vocabulary with the number of documents that hold each token, rare first. The result is as long as the vocabulary."""
    found = docs.select(F.explode(F.array_intersect(_lit(vocabulary), F.split(F.lower(text), SEPARATORS))).alias("w")).groupBy("w").count()
    n = {r[0]: r[1] for r in found.collect()}
    return sorted(((w, n.get(w, 0)) for w in vocabulary), key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, places (start, label) of phrases, matches (label, containment) of templates."""
    spark = docs.sparkSession
    all_t = _templates(phrases, templates)
    order = token_order(docs, sorted({t for x in all_t for t in x["tokens"]}), text)
    rank = {w: i for i, (w, _) in enumerate(order)}
    occurs = {w for w, n in order if n}
    entries = []
    for k, t in enumerate(all_t):
        tokens = sorted(t["tokens"], key=rank.get)
        prefix = tokens[: len(tokens) - t["need"] + 1]
        entries += [(k, t["base"], t["label"], t["mark"], tokens, prefix, t["need"], i, w) for i, w in enumerate(prefix) if w in occurs]
    index = spark.createDataFrame(entries, "template int, base boolean, label string, mark array<string>, t array<string>, t_prefix array<string>, need int, i int, token string")
    least = min(x["need"] for x in all_t)
    prefixes = sorted({e[-1] for e in entries}) or [""]

    lowered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("w", F.split(F.lower("t"), SEPARATORS))
    empty_first, empty_last = F.element_at("w", 1) == "", (F.size("w") > 1) & (F.element_at("w", -1) == "")
    n = (F.size("w") - empty_first.cast("int") - empty_last.cast("int")).cast("long")
    own = F.split(F.translate("t", UPPER, LOWER), SEPARATORS)
    gated = lowered.select("rid", "doc_id", n.alias("n_words"), F.when(F.arrays_overlap("w", _lit(prefixes)), F.slice(own, F.when(F.element_at("w", 1) == "", 2).otherwise(1), F.greatest(n, F.lit(0)).cast("int"))).alias("w"))
    blocks = gated.select("rid", "doc_id", "n_words", F.explode_outer(F.expr(f"if(w is null, null, transform(sequence(0, cast((n_words - 1) div {STEP} as int)), b -> struct(b * {STEP} as at, slice(w, b * {STEP} + 1, {2 * STEP}) as bw)))")).alias("k"))
    blocks = blocks.select("rid", "doc_id", "n_words", "k.at", "k.bw").withColumn("b", F.array_intersect(_lit([w for w, _ in order]), "bw"))
    # block tokens are in the global order, for array_intersect keeps that of its first argument
    probe = blocks.select("*", F.posexplode_outer(F.expr(f"slice(b, 1, greatest(size(b) - {least} + 1, 0))")).alias("j", "tok"))
    p, x = probe.alias("p"), F.broadcast(index).alias("x")
    pair = F.expr("p.tok = x.token and size(p.b) >= x.need and p.j <= size(p.b) - x.need and 1 + least(size(x.t) - x.i, size(p.b) - p.j) - 1 >= x.need and get(array_intersect(x.t_prefix, slice(p.b, 1, size(p.b) - x.need + 1)), 0) = p.tok")
    cand = p.join(x, pair, "left").withColumn("overlap", F.size(F.array_intersect("x.t", "p.b")))
    hit = F.expr("x.template is not null and overlap >= x.need")
    starts = F.expr(f"transform(filter(sequence(0, least({STEP}, size(bw)) - 1), s -> slice(bw, s + 1, size(mark)) = mark), s -> struct(cast(at + s as long) as start, label as label))")
    marked = F.expr("exists(sequence(1, size(bw)), s -> slice(bw, s, size(mark)) = mark)")
    cand = cand.select("rid", "doc_id", "n_words", F.when(hit & F.col("base"), starts).alias("places"), F.when(hit & ~F.col("base") & marked, F.struct("label", (F.col("overlap") / F.size("t")).alias("containment"))).alias("m"))
    return cand.groupBy("rid", "doc_id", "n_words").agg(F.flatten(F.collect_list("places")).alias("places"), F.collect_set("m").alias("matches")).drop("rid")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.expr("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.expr("places.label"), F.expr("matches.label"))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.expr("matches.containment")), F.lit(0.0)))
    return s.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.expr("places.start")).alias("first_word"), F.array_max(F.expr("places.start")).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _oracle() -> str:
    ts = _templates(PHRASES, TEMPLATES)
    arr = lambda v: "[" + ", ".join(f"'{w}'" for w in v) + "]"
    rows = ", ".join(f"({x['base']}, '{x['label']}', {arr(x['mark'])}, {arr(x['tokens'])}, {x['need']})" for x in ts)
    return f"""
with d as (select row_number() over () rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from documents),
tpl(base, label, mark, t, need) as (values {rows}),
p as (select rid, s - 1 start, label from (select rid, w, unnest(range(1, len(w) + 1)) s from d where len(w) > 0), tpl where base and w[s] = mark[1] and w[s:s + len(mark) - 1] = mark),
b as (select rid, w[o + 1:o + {2 * STEP}] bw from (select rid, w, unnest(range(0, len(w), {STEP})) o from d)),
m as (select rid, label, max(c) c from (select rid, label, len(list_intersect(t, bw)) c1, len(list_intersect(t, bw)) / len(t) c, need, bw, mark from b, tpl where not base) where c1 >= need and len(list_filter(range(1, len(bw) + 1), lambda i: bw[i] = mark[1] and bw[i:i + len(mark) - 1] = mark)) > 0 group by all),
pa as (select rid, count(*) n, min(start) f, max(start) l, list(distinct label) ls from p group by rid), ma as (select rid, list(distinct label) ls, max(c) c from m group by rid)
select doc_id, len(w)::bigint n_words, coalesce(pa.n, 0)::bigint n_base, pa.f::bigint first_word, pa.l::bigint last_word, coalesce(array_to_string(list_sort(pa.ls), ','), '') base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(pa.ls, []), coalesce(ma.ls, [])))), ','), '') labels, case when pa.n > 0 then 1.0 else coalesce(ma.c, 0) end::double score
from d left join pa using (rid) left join ma using (rid)
"""


OP1_SQL = _oracle()
