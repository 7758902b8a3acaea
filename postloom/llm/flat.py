"""Texts of an Arrow batch as flat byte arrays: words, hashes of spans, and row-wise Spark scans.

Hashes are polynomials over 64-bit integers with random byte values, so that the hash of any span
comes from two prefix sums. They choose candidates; results that must be exact compare bytes too.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: which bytes lie in one of the closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Letters, digits and all bytes of non-ASCII characters, after lower-casing A-Z.
PLAIN_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def byte_values(which: int) -> np.ndarray:
    """A random value for each byte."""
    pool = process_pool()
    if ("bytes", which) not in pool:
        pool["bytes", which] = np.random.default_rng(7 + which).integers(1, 2**64, 256, np.uint64)
    return pool["bytes", which]


def process_pool() -> dict:
    """What a worker process keeps between tasks.

    Functions travel to workers by value, each with module globals of its own, so the pool hangs on
    the interpreter.
    """
    return sys.__dict__.setdefault("_postloom_pool", {})


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64; kept, as every slice needs them."""
    pool = process_pool()
    have = pool.get(("powers", which))
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        base, one = _BASES[which], np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            up = np.concatenate([one, np.full(size - 1, base, np.uint64)]).cumprod(dtype=np.uint64)
            inverse = np.uint64(pow(base, -1, 2**64))
            down = np.concatenate([one, np.full(size - 1, inverse)]).cumprod(dtype=np.uint64)
        have = pool["powers", which] = (up, down)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit integers over all their bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Sums:
    """Prefix sums over 64-bit values; ``spans`` hashes value ranges in constant time each."""

    def __init__(self, values: np.ndarray, which: int = 0) -> None:
        up, self.down = _powers(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all ranges of ``n`` values."""
        count = max(0, len(self.sums) - n)
        return mixed((self.sums[n:] - self.sums[:count]) * self.down[:count])


def byte_sums(data: np.ndarray, which: int = 0) -> Sums:
    return Sums(byte_values(which)[data], which)


class Words:
    """Words of a slice: byte ranges, and the range of words of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> None:
        self.data, n = data, len(data)
        flags = member[data]
        fresh, last = np.empty(n, bool), np.empty(n, bool)
        if n:
            fresh[0], last[-1] = True, True
            np.logical_not(flags[:-1], out=fresh[1:])
            np.logical_not(flags[1:], out=last[:-1])
            fresh[offsets[offsets < n]] = True
            last[offsets[offsets > 0] - 1] = True
        self.start = np.flatnonzero(flags & fresh)
        self.end = np.flatnonzero(flags & last) + 1
        #: Word numbers at which rows begin, and the number of words.
        self.rows = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.rows)

    def hashes(self, which: int = 0) -> np.ndarray:
        return byte_sums(self.data, which).spans(self.start, self.end)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows with up to ``limit`` bytes, or one longer row: first row, bytes, offsets.

    Null texts are empty. Rows are never cut.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, places, content = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content or b"", np.uint8)
    first = 0
    while first < len(texts):
        upto = int(np.searchsorted(places, places[first] + limit, "right")) - 1
        upto = min(max(upto, first + 1), len(texts))
        yield first, data[places[first] : places[upto]], places[first : upto + 1] - places[first]
        first = upto


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``start``, one range after another."""
    length = np.asarray(length, np.int64)
    ends = length.cumsum()
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(np.asarray(start, np.int64) - ends + length, length)


def fresh_name(name: str, taken: Sequence[str]) -> str:
    """``name`` with underscores before it until no column has it, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def add_columns(
    docs: DataFrame, text_col: str, ddl: str, make: Callable[[], Callable[[pa.Array], Sequence]]
) -> DataFrame:
    """Append columns computed from the text of each row.

    ``make`` runs once per task and returns a function from an array of texts to one array per
    new column. Rows neither move nor change their order.
    """
    added = T.StructType.fromDDL(ddl)
    schema = T.StructType(docs.schema.fields + added.fields)
    place = docs.columns.index(text_col)
    kinds = [field.type for field in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            new = [
                x if isinstance(x, pa.Array) else pa.array(x, kind)
                for x, kind in zip(compute(batch.column(place)), kinds, strict=True)
            ]
            names = [*batch.schema.names, *added.names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return docs.mapInArrow(run, schema)
