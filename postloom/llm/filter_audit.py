"""How filters interact: what each removes, in every order in which they could be applied.

1. One scan gives each document the mask of the filters that it fails by its own text, and a 128-bit
   digest of the text. Whether an equal text has a smaller id is settled on those narrow rows: sums per
   (text, part) combine before they are shuffled, so a text that a third of all rows share costs a
   few rows per task.
2. Per part, the counts of each mask become a decision diagram: one variable per filter, a missing
   variable means that the filter is passed, equal sub-diagrams are one node, and every node has the
   sum of its counts.
3. All orders are walked by swaps of adjacent levels. In each, the path on which every filter is passed
   gives the steps: at its node of a filter, the failing branch holds what is removed there, the
   passing branch what is kept.

Defined cases: a null text is empty, a null part is the empty string; a null id is larger than all
others, and rows of equal ids or without an id never make each other copies; repeated labels of a
document count if any of them does; documents without labels are neither good nor toxic; an empty
table gives no rows. A part has at most 32 masks, so its group is small however many documents it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT = (80, 100)
UPPER = (10, 100)
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_INSIDE = bytes(range(0x80, 0xC0))  # bytes after the first of a character
COUNTS = ("n", "good", "toxic")


def failures(text: bytes, min_words: int = MIN_WORDS, distinct=DISTINCT, upper=UPPER, symbols: bytes = SYMBOLS) -> int:
    """Bits of the first four filters that the text fails. ``bytes.split`` cuts at blanks, tabs and line ends."""
    words = text.split()
    few = len(words) < min_words
    repeated = distinct[1] * len(set(words)) < distinct[0] * len(words)
    capitals = len(text) - len(text.translate(None, _UPPER))
    loud = upper[1] * capitals > upper[0] * len(text.translate(None, _INSIDE))
    marked = len(text.translate(None, symbols)) < len(text)
    return few | repeated << 1 | loud << 2 | marked << 3


def scanned(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id``, ``part``, ``mask`` of the first four filters, and ``d1``, ``d2``, the text's digest."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for text in batch.column(2).cast(pa.large_binary()):
                text = text.as_py() or b""
                masks.append(failures(text))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), *map(pa.array, (both[:, 0].copy(), both[:, 1].copy()))],
                names=["id", "part", "mask", "d1", "d2"],
            )

    return rows.mapInArrow(run, "id bigint, part string, mask int, d1 bigint, d2 bigint")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows ``(part, mask, n, good, toxic)``: documents by the set of all filters that they fail."""
    digest = ["d1", "d2"]
    rows = scanned(docs, id_col, text_col, part_col).groupBy("id", *digest, "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id have no labels; a second key spreads them over the tasks of the join.
    spread = F.when(F.col("id").isNull(), F.col("d1")).otherwise(0).alias("spread")
    rows = rows.withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0).cast("bigint")), ["id", "spread"], "left")
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    # Ids in order, null last; ids are distinct within these groups.
    rank = F.struct(F.col("id").isNull().alias("none"), "id")
    texts = rows.select(*digest, "part", "mask", *known, "n", rank.alias("rank"))
    texts = texts.groupBy(*digest, "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("rank").alias("least"), F.min_by("n", "rank").alias("at_least")
    )
    # A text has a row per part and kind of label here, however many documents have it.
    first = F.min("least").over(Window.partitionBy(*digest))
    texts = texts.withColumn("first", first)
    alone = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copies = F.lit(1 << FILTERS.index("E"))
    both = F.array(
        F.struct(F.col("mask").alias("mask"), alone.alias("n")),
        F.struct(F.col("mask").bitwiseOR(copies).alias("mask"), (F.col("n") - alone).alias("n")),
    )
    split = texts.select("part", "good", "toxic", F.inline(both)).filter("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    )


class Diagram:
    """A decision diagram over failure masks whose leaves are vectors of counts.

    A node is ``(variable, passed, failed)``. A node whose failing branch is empty is left out, so a
    variable that a path does not name is passed. Nodes are shared by content; ``order`` lists the
    variables from the top.
    """

    EMPTY = 0

    def __init__(self, weights: dict[int, tuple[int, ...]], order: Sequence[int]) -> None:
        self.order = list(order)
        self.width = len(next(iter(weights.values()), ()))
        self.nodes: list[tuple] = [(None, (0,) * self.width, None)]
        self.sums: list[tuple[int, ...]] = [(0,) * self.width]
        self.numbers: dict[tuple, int] = {self.nodes[0]: self.EMPTY}
        self.root = self._build({m: w for m, w in weights.items() if any(w)}, 0)

    def _number(self, node: tuple, total: tuple[int, ...]) -> int:
        if node not in self.numbers:
            self.numbers[node] = len(self.nodes)
            self.nodes.append(node)
            self.sums.append(total)
        return self.numbers[node]

    def make(self, variable: int, passed: int, failed: int) -> int:
        if failed == self.EMPTY:
            return passed
        total = tuple(a + b for a, b in zip(self.sums[passed], self.sums[failed], strict=True))
        return self._number((variable, passed, failed), total)

    def _build(self, weights: dict[int, tuple[int, ...]], level: int) -> int:
        if not weights:
            return self.EMPTY
        if level == len(self.order):
            total = next(iter(weights.values()))
            return self._number((None, total, None), total)
        bit = 1 << self.order[level]
        failed = {m ^ bit: w for m, w in weights.items() if m & bit}
        passed = {m: w for m, w in weights.items() if not m & bit}
        return self.make(self.order[level], self._build(passed, level + 1), self._build(failed, level + 1))

    def branches(self, node: int, variable: int) -> tuple[int, int]:
        """What a node holds where the variable, at its level or above it, is passed and failed."""
        name, passed, failed = self.nodes[node]
        return (passed, failed) if name == variable else (node, self.EMPTY)

    def swap(self, level: int) -> None:
        """Exchange the variables of a level and the next one; all else stays shared as it is."""
        upper, lower = self.order[level : level + 2]
        above = set(self.order[:level])
        seen: dict[int, int] = {}

        def swapped(node: int) -> int:
            if node not in seen:
                name, passed, failed = self.nodes[node]
                if name in above:
                    seen[node] = self.make(name, swapped(passed), swapped(failed))
                elif name == upper:
                    pp, pf = self.branches(passed, lower)
                    fp, ff = self.branches(failed, lower)
                    seen[node] = self.make(lower, self.make(upper, pp, fp), self.make(upper, pf, ff))
                else:
                    seen[node] = node
            return seen[node]

        self.root = swapped(self.root)
        self.order[level : level + 2] = lower, upper

    def all_pass(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Along the path that passes every filter, in order: counts kept, and counts removed."""
        steps, node = [], self.root
        for variable in self.order:
            node, failed = self.branches(node, variable)
            steps.append((self.sums[node], self.sums[failed]))
        return steps


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions whose swaps with their right neighbour lead through all orders of ``n`` things."""
    if n < 2:
        return
    # The largest walks from end to end; between its walks the others make one step.
    inner, left = adjacent_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if left else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + (1 if left else 0)
        left = not left


def audit_part(weights: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[dict]:
    """A row per order and step; ``weights`` has the counts ``(n, good, toxic)`` of each mask."""
    diagram = Diagram(weights or {0: (0, 0, 0)}, range(len(filters)))
    failing = [sum(w[0] for m, w in weights.items() if m >> i & 1) for i in range(len(filters))]
    only = [weights.get(1 << i, (0,))[0] for i in range(len(filters))]
    rows, shapley = [], [0] * len(filters)

    def walk() -> None:
        name = "".join(filters[v] for v in diagram.order)
        for step, (variable, (kept, removed)) in enumerate(zip(diagram.order, diagram.all_pass(), strict=True), 1):
            shapley[variable] += removed[0]
            rows.append(
                {
                    "filter_order": name,
                    "step": step,
                    "kept": kept[0],
                    "removed": removed[0],
                    "redundant": failing[variable] - removed[0],
                    "unique_fails": only[variable],
                    "good_lost": removed[1],
                    "toxic_lost": removed[2],
                }
            )

    walk()
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        walk()
    for row in rows:
        row["shapley"] = shapley[filters.index(row["filter_order"][row["step"] - 1])]
    return rows


_AUDIT = pa.schema(
    [("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
    + [(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the rows of ``mask_counts``."""

    def of_part(rows: pa.Table) -> pa.Table:
        masks = rows.column("mask").to_pylist()
        weights = dict(zip(masks, zip(*(rows.column(c).to_pylist() for c in COUNTS), strict=True), strict=True))
        part = rows.column("part")[0].as_py()
        return pa.Table.from_pylist([{"part": part, **row} for row in audit_part(weights, filters)], _AUDIT)

    columns = "kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
    return counts.groupBy("part").applyInArrow(of_part, f"part string, filter_order string, step int, {columns}")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_counts(docs, labels))
