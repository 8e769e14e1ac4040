"""Operator 12, Merkle dataset manifest: a radix-ranked trie.

Each row is a leaf, the SHA-256 of its columns. The leaves of a group (a language) ascend by id. Their exact ranks come
from hierarchical histograms of the ids' digits of `DIGIT` bits: rows are counted by the ids without their last digit,
these counts by the digit before, and so on up to the whole group. A row's rank is the number of rows under smaller
digits of the same parent, summed over the levels, and its place among the rows of its own last bucket. Each parent has
at most 2^DIGIT children, so nothing is sorted or numbered as a whole. A bucket of more than `CROWD` rows (ids repeat)
is counted by its ids, and an id of more than CROWD rows by three digits of its leaves. Equal leaves of one id are one
row with a count until they are placed.

Ranks written in base `FANOUT` are the trie's keys: `DEPTH` digits at a time are reduced, longest prefix first, in
groups of FANOUT^DEPTH nodes at most, to one node for each prefix; the nodes of the prefixes follow in the same way, a
FANOUT^DEPTH-th as many each time, until one is left for each group: its subroot. The subroots are the leaves of a last
tree in the order of the groups' names. Proofs are made on the way down: each prefix hands the siblings of its own path
to the nodes below it. Leaves are folded with these siblings up to the root.

Defined cases: a null column is `-` in its leaf, so differs from an empty one; a group without a name comes first, and
so do rows without an id in their group; rows with one id are in the order of their leaves; equal rows are leaves of
their own, side by side; an empty table gives an empty table; rows without an id are never among those tampered with;
further columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, lean, load, ranked, ship, small_join

FANOUT = 8
#: Levels that are reduced in one group, of FANOUT ** DEPTH nodes at most.
DEPTH = 4
DIGIT = 8
CROWD = 20_000
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the columns: `-` for null, else the UTF-8 byte count, `:` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def ranks(leaves: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(g, id, leaf, ..., m) with the rank `r` of the first of the m equal leaves in its group g, and the group's size `n`; a null id comes first."""
    span = leaves.agg(F.min("id"), F.max("id")).first()
    shifts, top = [], DIGIT
    while span[0] is not None and top < 64:
        shifts.append(top)
        if span[0] >> top == span[1] >> top:
            break
        top += DIGIT
    # digits from the first: an id or none (z), the id without its last digit (b), the id (c), digits of the leaf (d); the last two only in crowded buckets
    rows = leaves.withColumns({"z": F.col("id").isNotNull().cast("int"), "x": F.coalesce("id", F.lit(0))}).withColumn("b", F.shiftright("x", DIGIT))
    many = lambda by: small_join(Stored(rows.groupBy(*by).agg(F.sum("m").alias("n")).where(F.col("n") > crowd).select(*by, F.lit(True).alias("many_" + by[-1])), "crowded").df)
    rows = rows.join(many(["g", "z", "b"]), ["g", "z", "b"], "left").join(many(["g", "z", "x"]), ["g", "z", "x"], "left")
    rows = rows.withColumns({"c": F.when(F.col("many_b"), F.col("x")).otherwise(F.lit(None)), "d": F.when(F.col("many_x"), F.conv(F.substring("leaf", 1, 3), 16, 10).cast("int"))})
    rows = rows.withColumns({"c": F.coalesce("c", F.lit(0)), "d": F.coalesce("d", F.lit(-1))}).drop("many_b", "many_x")
    counts = Stored(rows.groupBy("g", "z", "b", "c", "d").agg(F.sum("m").alias("n")), "digits").df
    # from the last digit to the first: (keys of the parent, digit)
    steps = [(["g", "z", "b", "c"], "d"), (["g", "z", "b"], "c")]
    key = "b"
    level = counts
    offsets = counts.select("g", "z", "b", "c", "d")
    for parent, digit in steps:
        level = level.groupBy(*parent, digit).agg(F.sum("n").alias("n"))
        offsets = offsets.join(_before(level, parent, digit), [*parent, digit])
    for k, _ in enumerate(shifts):
        up = f"b{k}"
        level = level.groupBy("g", "z", key).agg(F.sum("n").alias("n")).withColumn(up, F.shiftright(key, DIGIT))
        offsets = offsets.join(_before(level, ["g", "z", up], key).drop(up), ["g", "z", key]).withColumn(up, F.shiftright(key, DIGIT))
        level = level.groupBy("g", "z", up).agg(F.sum("n").alias("n"))
        key = up
    level = level.groupBy("g", "z", key).agg(F.sum("n").alias("n"))
    offsets = offsets.join(_before(level, ["g", "z"], key), ["g", "z", key])
    level = level.groupBy("g", "z").agg(F.sum("n").alias("n"))
    offsets = offsets.join(_before(level, ["g"], "z"), ["g", "z"])
    offsets = offsets.join(level.groupBy("g").agg(F.sum("n").alias("n")), "g")
    begin = sum((F.col(c) for c in offsets.columns if c.startswith("before_")), F.lit(0))
    offsets = small_join(Stored(offsets.select("g", "z", "b", "c", "d", begin.alias("begin"), "n"), "offsets").df)
    own = Window.partitionBy("g", "z", "b", "c", "d").orderBy("x", "leaf")
    return rows.withColumn("own", F.sum("m").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).join(offsets, ["g", "z", "b", "c", "d"]).withColumn("r", F.col("begin") + F.col("own")).drop("z", "x", "b", "c", "d", "own", "begin")


def _before(level: DataFrame, parent: list[str], digit: str) -> DataFrame:
    """Rows under smaller digits of the same parent."""
    w = Window.partitionBy(*parent).orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    return level.select(*parent, digit, (F.sum("n").over(w) - F.col("n")).alias(f"before_{digit}"))


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    k = 0
    while FANOUT**k < n:
        k += 1
    return k


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and those of each level above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_h("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        out.append(nodes)
    return out


def paths(levels: list[list[str]], lefts: list[str], rights: list[str]) -> tuple[list[list[str]], list[list[str]]]:
    """For each lowest node, the siblings left and right of its path, level by level, those given being of the levels above."""
    left, right = [lefts], [rights]
    for nodes in levels[-2::-1]:
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        left, right = [["".join(run[:i]), *left[k]] for k, run in enumerate(runs) for i in range(len(run))], [["".join(run[i + 1 :]), *right[k]] for k, run in enumerate(runs) for i in range(len(run))]
    return left, right


def fold(node: str, lefts: list[str], rights: list[str]) -> str:
    for a, b in zip(lefts, rights, strict=True):
        node = _h(a + node + b)
    return node


def _up(group: pa.Table, depth: int) -> pa.Table:
    """One node of a prefix's nodes; runs of equal ones are unrolled."""
    group = group.sort_by("r")
    n = group["n"][0].as_py()
    nodes = [h for h, m in zip(group["h"].to_pylist(), group["m"].to_pylist(), strict=True) for _ in range(m)]
    top = climb(nodes, min(depth, levels_of(n)))[-1]
    size = FANOUT**depth
    return pa.table({"g": group["g"][:1], "r": [group["r"][0].as_py() // size], "n": [-(-n // size)], "h": top, "m": pa.array([1], pa.int64())})


def _down(group: pa.Table, above: pa.Table, depth: int) -> pa.Table:
    """Paths of a prefix's nodes, given that of the prefix."""
    group = group.sort_by("r")
    levels = climb(group["h"].to_pylist(), min(depth, levels_of(group["n"][0].as_py())))
    left, right = paths(levels, above["lefts"][0].as_py(), above["rights"][0].as_py())
    return pa.table({"g": group["g"], "q": group["r"], "lefts": pa.array(left, pa.list_(pa.string())), "rights": pa.array(right, pa.list_(pa.string())), "subroot": [above["subroot"][0].as_py()] * len(left), "root": [above["root"][0].as_py()] * len(left)})


def _leaves(group: pa.Table, above: pa.Table, depth: int) -> pa.Table:
    """A row for each leaf of a prefix: its proof, and the root folded from what is presented as the leaf."""
    group = group.sort_by("r")
    pick = [i for i, m in enumerate(group["m"].to_pylist()) for _ in range(m)]
    leaf, given, ids = group["h"].to_pylist(), group["given"].to_pylist(), group["id"].to_pylist()
    lefts, rights = above["lefts"][0].as_py(), above["rights"][0].as_py()
    levels = climb([leaf[i] for i in pick], min(depth, levels_of(group["n"][0].as_py())))
    left, right = paths(levels, lefts, rights)
    proof = ["".join(x + y for x, y in zip(a, b, strict=True)) for a, b in zip(left, right, strict=True)]
    root = [fold(given[i], a, b) for i, a, b in zip(pick, left, right, strict=True)]
    k, size = group["r"][0].as_py(), len(pick)
    return pa.table({
        "g": [group["g"][0].as_py()] * size, "id": pa.array([ids[i] for i in pick], pa.int64()), "rank": pa.array(range(k, k + size), pa.int64()), "leaf": [leaf[i] for i in pick],
        "subroot": [above["subroot"][0].as_py()] * size, "root": [above["root"][0].as_py()] * size, "proof": proof, "folded_root": root,
    })


_NODES = "g string, r long, n long, h string, m long"
_PATHS = "g string, q long, lefts array<string>, rights array<string>, subroot string, root string"
_PROOFS = "g string, id long, rank long, leaf string, subroot string, root string, proof string, folded_root string"


class Trie:
    """The steps up and down a trie whose nodes are reduced `depth` levels at a time."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, FANOUT**depth

    def prefix(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("q", F.expr(f"r div {self.size}"))

    def reduced(self, nodes: DataFrame) -> list[DataFrame]:
        """Tables of nodes from the given one up to that of one node for each group."""
        depth = self.depth
        out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
        while True:
            low = self.prefix(out[-1]).select("g", "q", "r", "n", "h", "m")
            out.append(Stored(low.groupBy("g", "q").applyInArrow(lean(lambda t: _up(t, depth)), _NODES), "nodes").df)
            most = -(-most // self.size)
            if most <= 1:
                return out

    def beside(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """Paths of nodes, given those of their prefixes."""
        depth = self.depth
        return self.prefix(nodes).select("g", "q", "r", "n", "h").groupBy("g", "q").cogroup(above.groupBy("g", "q")).applyInArrow(lean(lambda t, a: _down(t, a, depth)), _PATHS)

    def paths(self, tables: list[DataFrame], above: DataFrame) -> DataFrame:
        """Paths of the prefixes of the lowest table, from those of the groups."""
        for nodes in reversed(tables[1:-1]):
            above = Stored(self.beside(nodes, above), "paths").df
        return above

    def leaves(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        depth = self.depth
        return self.prefix(nodes).groupBy("g", "q").cogroup(above.groupBy("g", "q")).applyInArrow(lean(lambda t, a: _leaves(t, a, depth)), _PROOFS)


def manifest(rows: DataFrame, crowd: int = CROWD, depth: int = DEPTH) -> DataFrame:
    """Proofs of all leaves of (g, id, leaf, given): group, id, leaf, and what is presented as the leaf (null: the leaf itself).

    Returns g, id, rank, leaf, subroot, root, `proof` (the siblings' digests, level by level, left to right) and
    folded_root, which equals the root only if what was presented is what the root was made of.
    """
    ship(rows.sparkSession)
    trie = Trie(depth)
    name = F.coalesce(F.concat(F.lit("="), "g"), F.lit("-"))
    leaves = Stored(rows.groupBy(name.alias("g"), "id", "leaf", F.coalesce("given", "leaf").alias("given")).agg(F.count("*").alias("m")), "leaves").df
    placed = ranks(leaves, crowd)
    # a run of equal leaves is cut where prefixes end
    cut = placed.withColumn("q", F.explode_outer(F.expr(f"sequence(r div {trie.size}, (r + m - 1) div {trie.size})")))
    begin = F.greatest("r", F.col("q") * trie.size)
    cut = cut.withColumn("end", F.least(F.col("r") + F.col("m"), (F.col("q") + 1) * trie.size)).withColumn("r", begin).withColumn("m", F.col("end") - F.col("r"))
    nodes = Stored(cut.select("g", "r", "n", F.col("leaf").alias("h"), "m", "id", "given"), "ranked").df
    tables = trie.reduced(nodes)
    groups = ranked(tables[-1].select("g", "h"), ["g"], "groups").withColumnRenamed("rank", "r")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    top = trie.reduced(Stored(groups.select(F.lit("").alias("g"), "r", F.lit(groups.count()).cast("long").alias("n"), "h", one.alias("m"), F.col("g").alias("name")), "subroots").df)
    none = F.expr("cast(array() as array<string>)")
    above = trie.paths(top, top[-1].select("g", zero.alias("q"), none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("h").alias("root")))
    named = top[0].select(F.col("r").alias("q"), "name", F.col("h").alias("own")).join(trie.beside(top[0], above).select("q", "lefts", "rights", "root"), "q")
    of_groups = Stored(named.select(F.col("name").alias("g"), zero.alias("q"), "lefts", "rights", F.col("own").alias("subroot"), "root"), "paths").df
    out = trie.leaves(nodes, trie.paths(tables, of_groups))
    return out.withColumn("g", F.when(F.col("g") != "-", F.substring("g", 2, 1 << 30)))


A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_of([F.translate("text", A_Z, A_Z.lower()) if c == "text" else F.col(c) for c in COLUMNS]))
    rows = docs.select(F.col("lang").alias("g"), F.col("doc_id").alias("id"), leaf_of([F.col(c) for c in COLUMNS]).alias("leaf"), tampered.alias("given"))
    return manifest(rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels, siblings and folds by recursion; crc32 of the ids' decimals bit by bit.
OP12_SQL = """
with recursive parts as (
    select row_number() over () as k, doc_id, lang, text,
        coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
        list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: ascii(substr(cast(doc_id as varchar), i, 1))::bigint)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) as crc
    from documents),
leaves as (
    select k, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when xor(crc, 4294967295) % 3 = 0 then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as given
    from parts),
placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n,
        dense_rank() over (order by lang nulls first) - 1 as g from leaves),
tree as (
    select g, 0 as level, pos, n, leaf as h from placed
    union all
    select g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from tree where n > 1 group by g, level, pos // 8, n),
subroots as (select g, h as subroot from tree where n = 1),
high as (
    select 0 as level, cast(g as bigint) as pos, (select count(*) from subroots) as n, subroot as h from subroots
    union all
    select level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from high where n > 1 group by level, pos // 8, n),
steps as (
    select g, level, pos,
        coalesce(string_agg(h, '') over (partition by g, level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as a,
        coalesce(string_agg(h, '') over (partition by g, level, pos // 8 order by pos rows between 1 following and unbounded following), '') as b
    from tree where n > 1),
high_steps as (
    select level, pos,
        coalesce(string_agg(h, '') over (partition by level, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as a,
        coalesce(string_agg(h, '') over (partition by level, pos // 8 order by pos rows between 1 following and unbounded following), '') as b
    from high where n > 1),
folded as (
    select k, g, 0 as level, pos, coalesce(given, leaf) as h, '' as proof from placed
    union all
    select f.k, f.g, f.level + 1, f.pos // 8, sha256(s.a || f.h || s.b), f.proof || s.a || s.b from folded f join steps s on s.g = f.g and s.level = f.level and s.pos = f.pos),
half as (select k, g, arg_max(h, level) as h, arg_max(proof, level) as proof from folded group by k, g),
whole as (
    select k, 0 as level, cast(g as bigint) as pos, h, proof from half
    union all
    select w.k, w.level + 1, w.pos // 8, sha256(s.a || w.h || s.b), w.proof || s.a || s.b from whole w join high_steps s on s.level = w.level and s.pos = w.pos),
ends as (select k, arg_max(h, level) as h, arg_max(proof, level) as proof from whole group by k),
root as (select h as root from high where n = 1)
select p.doc_id, p.leaf, s.subroot, r.root, sha256(e.proof) as proof_sha256, e.h as folded_root, e.h = r.root as verified
from placed p join subroots s using (g) join ends e using (k) cross join root r"""
