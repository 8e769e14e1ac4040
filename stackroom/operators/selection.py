"""Boxes on pages: figure labels, selections, duplicate detections. Pairs meet on their page only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship
from .shared import stored

# Fixed values, in points.
MIN_X, MIN_Y_COVER, MIN_AREA, MIN_SHARE, NEAR = 4.0, 0.5, 80.0, 0.4, 0.5

#: Rows of a page up to which its duplicates are dropped by one walk, and kept boxes up to which each is looked at.
WALKED, FEW = 100_000, 16


def _overlap(a: str, b: str, lo: str, hi: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))


def figure_labels(texts: DataFrame, figures: DataFrame, most: int = 40) -> DataFrame:
    """Short texts without sentence punctuation, half of whose area lies in a figure of their page."""
    t = texts.where((F.length("text") <= most) & ~F.col("text").rlike("[.!?。！？]")).alias("t")
    f = figures.alias("f")
    inside = _overlap("t", "f", "x0", "x1") * _overlap("t", "f", "y0", "y1")
    area = (F.col("t.x1") - F.col("t.x0")) * (F.col("t.y1") - F.col("t.y0"))
    return t.join(f, (F.col("t.doc") == F.col("f.doc")) & (F.col("t.page") == F.col("f.page")) & (inside >= 0.5 * area), "left_semi")


def selected(rects: DataFrame, paragraphs: DataFrame, words: Column) -> DataFrame:
    """Ids of paragraphs that a selection covers by geometry and whose text supports the selected words."""
    return selected_blocks(rects, paragraphs, words).select("id")


def selected_blocks(rects: DataFrame, blocks: DataFrame, words: Column) -> DataFrame:
    """(doc, id) of blocks that a document's selection covers: enough of the rectangles' area, and a text that supports the selected words."""
    total = rects.groupBy("doc").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("total"))
    r, b = rects.alias("r"), blocks.alias("b")
    dx, dy = _overlap("r", "b", "x0", "x1"), _overlap("r", "b", "y0", "y1")
    line = F.least(F.col("r.y1") - F.col("r.y0"), F.col("b.y1") - F.col("b.y0"))
    j = r.join(b, (F.col("r.doc") == F.col("b.doc")) & (F.col("r.page") == F.col("b.page")) & (dx >= MIN_X) & (line > 0) & (dy >= MIN_Y_COVER * line))
    hit = j.groupBy(F.col("b.doc").alias("doc"), F.col("b.id").alias("id")).agg(F.sum(dx * dy).alias("area"), F.first("b.text").alias("text")).join(total, "doc")
    return hit.where(F.col("area") >= F.least(F.lit(MIN_AREA), MIN_SHARE * F.col("total"))).where(T.text_supports(words, F.col("text"))).select("doc", "id")


_EDGES = ["x0", "y0", "x1", "y1"]


def _order(id: str) -> list[Column]:
    return [F.coalesce(-F.col("score"), F.lit(float("inf"))), F.col(id)]


class _Page:
    """The kept boxes of a page: a list while they are few, then by cells of their four edges, four times as wide as NEAR."""

    def __init__(self) -> None:
        self.few: list[tuple] = []
        self.cells: dict[tuple, list[tuple]] = {}
        self.odd: set[tuple] = set()

    def keeps(self, finite: bool, box: tuple) -> bool:
        """Whether a walk keeps the box, which then is one of the kept."""
        if not finite:
            # near no box, but of equal ones the first is kept
            box = tuple("nan" if v != v else v for v in box)
            new = box not in self.odd
            self.odd.add(box)
            return new
        x0, y0, x1, y1 = box
        for a, b, c, d in self.around(box) if self.cells else self.few:
            if abs(x0 - a) <= NEAR and abs(y0 - b) <= NEAR and abs(x1 - c) <= NEAR and abs(y1 - d) <= NEAR:
                return False
        if not self.cells:
            self.few.append(box)
        for kept in [box] if self.cells else self.few if len(self.few) > FEW else ():
            self.cells.setdefault(tuple(v // (4 * NEAR) for v in kept), []).append(kept)
        return True

    def around(self, box: tuple) -> Iterator[tuple]:
        """What is kept in the box's cells, one or two an edge; the margin is wider than NEAR, for a difference may be rounded down to it."""
        for at in product(*({(v - 1.5 * NEAR) // (4 * NEAR), (v + 1.5 * NEAR) // (4 * NEAR)} for v in box)):
            yield from self.cells.get(at, ())


def _walked(boxes: DataFrame, key: str, id: str) -> DataFrame:
    """The boxes that are kept, by one walk over each page's rows: a worker streams through them with the kept ones of one page."""
    ship(boxes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page, begun = None, _Page(), False
        for b in batches:
            edges = [b.column(e).cast(pa.float64(), safe=False) for e in _EDGES]
            finite = reduce(pc.and_, [pc.fill_null(pc.is_finite(e), False) for e in edges])
            keep = []
            for k, f, box in zip(b.column(key).to_pylist(), finite.to_pylist(), zip(*(e.to_pylist() for e in edges), strict=True), strict=True):
                if not begun or k != now:
                    now, page, begun = k, _Page(), True
                keep.append(page.keeps(f, box))
            yield b.filter(pa.array(keep, pa.bool_()))

    return boxes.repartition(key).sortWithinPartitions(key, *_order(id), *_EDGES).mapInArrow(run, boxes.schema)


def conflicts(boxes: DataFrame, key: str = "page") -> DataFrame:
    """(key, better, worse): pairs of boxes of one page all of whose edges lie within NEAR of each other.

    `boxes` is (key, node), where node is a struct that begins with the order and holds the edges. A box is in the cell of
    its first corner and meets those of the nine cells around it. Cells are wider than NEAR, for a difference may be rounded down to it.
    """
    cell = lambda c: F.greatest(F.least(F.floor(F.col(f"node.{c}") / (2 * NEAR)).cast("long"), F.lit(1 << 62)), F.lit(-(1 << 62)))
    b = boxes.select(key, F.col("node").alias("better"), cell("x0").alias("cx"), cell("y0").alias("cy"))
    around = F.array(*[F.struct((cell("x0") + i).alias("cx"), (cell("y0") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    other = boxes.select(key, F.col("node").alias("worse"), F.explode(around).alias("c")).select(key, "worse", "c.cx", "c.cy")
    near = F.col("better") < F.col("worse")
    for e in _EDGES:
        near = near & (F.abs(F.col(f"better.{e}").cast("double") - F.col(f"worse.{e}").cast("double")) <= NEAR)
    return b.join(other, [key, "cx", "cy"]).where(near).select(key, "better", "worse")


def drop_duplicates(boxes: DataFrame, key: str = "page", id: str = "id", log: list[int] | None = None) -> DataFrame:
    """By falling score (null last), then id, boxes whose edges all lie within NEAR of a kept one are dropped.

    Pages are dealt to the tasks and walked in that order. One of more than WALKED rows, which one task shouldn't hold, goes
    in rounds that keep the same boxes. Boxes without a page are on one of their own. Of boxes with equal edges the first
    alone takes part, and of rows equal in edges, score and id one. `log` gets the number of boxes dropped in each round;
    with it all pages go in rounds.
    """
    if log is not None:
        return _in_rounds(boxes, key, id, log)
    long = stored(boxes.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n")).where(F.col("n") > WALKED).select("__k"), "long")
    if long.isEmpty():
        return _walked(boxes, key, id)
    # one row for each WALKED boxes at most
    on = boxes[key].eqNullSafe(F.col("__k"))
    rest = boxes.join(F.broadcast(long), on, "left_anti")
    return _walked(rest, key, id).unionByName(_in_rounds(boxes.join(F.broadcast(long), on, "left_semi"), key, id))


def _in_rounds(boxes: DataFrame, page: str, id: str, log: list[int] | None = None) -> DataFrame:
    """The boxes that are kept, in rounds over the table of conflicts: one that no undecided box precedes is kept, and what it conflicts with is dropped."""
    s, i = _order(id)
    # a struct, so that null is a page, too
    key = "__page"
    rows = boxes.withColumns({key: F.struct(page), "node": F.struct(s.alias("s"), i.alias("i"), *_EDGES)})
    one = stored(rows.groupBy(key, *_EDGES).agg(F.min("node").alias("node")).select(key, "node"), "boxes")
    left, gone = stored(conflicts(one, key), "conflicts"), None
    while not left.isEmpty():
        # what has a worse one and no better one beside it is kept, what it beats goes
        head = left.select(key, F.col("better").alias("node")).distinct().join(left.select(key, F.col("worse").alias("node")).distinct(), [key, "node"], "left_anti")
        lost = stored(left.withColumnRenamed("better", "node").join(head, [key, "node"]).select(key, F.col("worse").alias("node")).distinct(), "lost")
        if log is not None:
            log.append(lost.count())
        gone = lost if gone is None else gone.unionByName(lost)
        decided = stored(lost.unionByName(head), "decided")
        left = stored(left.join(decided.withColumnRenamed("node", "better"), [key, "better"], "left_anti").join(decided.withColumnRenamed("node", "worse"), [key, "worse"], "left_anti"), "conflicts")
    kept = one if gone is None else one.join(gone, [key, "node"], "left_anti")
    return rows.join(kept, [key, "node"], "left_semi").dropDuplicates([key, "node"]).select(*boxes.columns)
