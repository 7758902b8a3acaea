"""Joins and selections that stay balanced whatever the size or the skew of the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..session import shared_dir, shuffles_freed

BROADCAST_BYTES = 64 * 1024 * 1024
# Digits of the order that one count adds, digits in all, and rows that may be counted one by one.
HASH_DIGITS = 4
ORDER_DIGITS = 48
EDGE_ROWS = 100_000
# Accuracy of the sketches that bracket a quantile, rows a bracket may hold, and steps to get there.
SKETCH = 10_000
BRACKET_ROWS = 100_000
BRACKET_STEPS = 6


def table_bytes(table: DataFrame) -> int:
    """Measured size of a table's values as text, by one aggregate over it."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns),
        F.lit(16),
    )
    return table.agg(F.sum(width.cast("bigint"))).first()[0] or 0


def fits_in_memory(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is measured small enough to be sent to every executor."""
    return table_bytes(table) <= max_bytes


def row_digest(df: DataFrame) -> list[Column]:
    """Two hashes of a whole row, to find it again where no column is known to be unique."""
    return [F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)]


def settled(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key, with its smallest value; rows without a key are left out."""
    return table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def stored_once(table: DataFrame, name: str, **options: str | int) -> DataFrame:
    """The table written to the shared folder and read again, so that measuring and using it make it once."""
    path = shared_dir(table.sparkSession, name)
    with shuffles_freed(table.sparkSession):
        table.write.options(**options).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def lookup_join(
    df: DataFrame, table: DataFrame, on: str, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Left join to a table with one row per key.

    A table measured below ``max_bytes`` is broadcast. A larger one is sorted and merged, and
    adaptive execution splits the tasks that a hot key of ``df`` would make too large.
    """
    if fits_in_memory(table, max_bytes):
        return df.join(F.broadcast(table), on, "left")
    return df.join(table.hint("merge"), on, "left")


def lookup_dict(
    words: DataFrame, table: DataFrame, key: str, value: str, max_bytes: int
) -> dict | None:
    """The rows of a settled table as a dict, or None if it is measured too large for that.

    A large table is first cut to the keys that occur in ``words``, a column of the same name.
    """
    if not fits_in_memory(table, max_bytes):
        if not max_bytes:
            return None
        table = stored_once(table.join(words.select(key).distinct(), key, "left_semi"), "lookup")
        if not fits_in_memory(table, max_bytes):
            return None
    return {row[key]: row[value] for row in table.collect()}


def take_by_hash(
    df: DataFrame, n: int, seed: int, key: str, strata: str | None = None
) -> DataFrame:
    """Exactly the ``n`` rows (per stratum) that come first in the seeded hash order.

    The order is the hash of the key, then a hash of the whole row, so null and repeated keys are
    told apart too. Rows are counted per leading digits until the digits at the cut hold few rows;
    the last row taken is found among those, and a filter then reads the sample. Only counts and
    hashes are shuffled, never the rows themselves.
    """
    order = F.concat(
        seeded_hash(F.col(key), seed), F.lpad(F.hex(F.xxhash64(*df.columns)), 16, "0")
    )
    group = F.lit("") if strata is None else F.col(strata).cast("string")
    narrow = df.select(group.alias("g"), order.alias("o"))
    cuts: dict[str | None, tuple[str, int]] = {}
    left = None
    for digits in range(HASH_DIGITS, ORDER_DIGITS + HASH_DIGITS, HASH_DIGITS):
        rows = narrow if left is None else narrow.filter(_any_of(left, lambda p: F.col("o").startswith(p)))
        need = F.lit(n) if left is None else _by_group(left, lambda g: n - cuts[g][1])
        found = _cut(rows.select("g", F.substring("o", 1, digits).alias("o")), need)
        left = {}
        for row in found:
            before = row["before"] + (cuts[row["g"]][1] if row["g"] in cuts else 0)
            cuts[row["g"]] = (row["o"], before)
            if row["c"] > EDGE_ROWS:
                left[row["g"]] = row["o"]
        if not left:
            break
    rows = narrow.filter(_any_of({g: p for g, (p, _) in cuts.items()}, lambda p: F.col("o").startswith(p)))
    last = _cut(rows, _by_group(cuts, lambda g: n - cuts[g][1])) if cuts else []
    # One row per stratum: its last order, and how many rows of just that order belong to it.
    edge = {row["g"]: (row["o"], n - cuts[row["g"]][1] - row["before"]) for row in last}
    if not edge:
        return df if n > 0 and strata is None else df.limit(0)
    marked = df.withColumns({"__g": group, "__o": order})
    limit = _by_group(edge, lambda g: edge[g][0], F.col("__g"))
    whole = marked.filter(F.col("__o") < limit)
    within = Window.partitionBy("__g").orderBy("__o")
    same = marked.filter(F.col("__o") == limit).withColumn("__rank", F.row_number().over(within))
    same = same.filter(F.col("__rank") <= _by_group(edge, lambda g: edge[g][1], F.col("__g")))
    return whole.select(df.columns).unionByName(same.select(df.columns))


def _by_group(values: dict, of, group: Column | None = None) -> Column:
    """``of(g)`` of the row's group, one of a few."""
    group = F.col("g") if group is None else group
    out = None
    for g in values:
        same = group.eqNullSafe(F.lit(g))
        out = F.when(same, F.lit(of(g))) if out is None else out.when(same, F.lit(of(g)))
    return out


def _any_of(prefixes: dict, test) -> Column:
    out = F.lit(False)
    for g, prefix in prefixes.items():
        out = out | (F.col("g").eqNullSafe(F.lit(g)) & test(F.lit(prefix)))
    return out


def _cut(rows: DataFrame, need: Column) -> list:
    """Per group, the value of ``o`` at which ``need`` rows are reached (or the last one)."""
    counts = rows.groupBy("g", "o").agg(F.count("*").alias("c"))
    running = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
    below = placed.filter(F.col("before") < need)
    return below.groupBy("g").agg(F.max(F.struct("o", "before", "c")).alias("at")).select("g", "at.*").collect()


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as double, a timestamp as epoch seconds."""
    kind = df.schema[name].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        ntz = F.col(name).cast("timestamp_ntz")
        return (F.unix_micros(F.to_utc_timestamp(ntz, F.current_timezone())) / 1e6).cast("double")
    return F.col(name).cast("double")


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per column.

    An approximate sketch brackets each wanted rank between two values; one pass counts the rows
    below and within each bracket, and brackets that still hold many rows are narrowed the same
    way. Only the values within the last brackets, a bounded number, are shuffled and ranked.
    """
    doubles = df.select([F.nanvl(as_double(df, c), F.lit(None)).alias(c) for c in cols])
    spots = [(c, i) for c in cols for i in range(len(probabilities))]
    sizes = doubles.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    spots = [s for s in spots if sizes[s[0]]]
    position = {(c, i): probabilities[i] * (sizes[c] - 1) for c, i in spots}
    brackets: dict[tuple[str, int], tuple[float | None, float | None]] = dict.fromkeys(spots, (None, None))
    below = dict.fromkeys(spots, 0)
    inside = {s: sizes[s[0]] for s in spots}

    def within(c: str, low: float | None, high: float | None) -> Column:
        test = F.col(c).isNotNull()
        test = test if low is None else test & (F.col(c) >= F.lit(float(low)))
        return test if high is None else test & (F.col(c) <= F.lit(float(high)))

    open_spots = [s for s in spots if inside[s] > BRACKET_ROWS]
    for _ in range(BRACKET_STEPS):
        if not open_spots:
            break
        picks = []
        for n, s in enumerate(open_spots):
            share = (position[s] - below[s]) / inside[s]
            ends = f"array({max(share - 2 / SKETCH, 0)}D, {min(share + 2 / SKETCH, 1)}D)"
            value = F.when(within(s[0], *brackets[s]), F.col(s[0])).alias("v")
            picks.append((n, value, ends))
        sketch = doubles.select(*[v.alias(f"v{n}") for n, v, _ in picks]).agg(
            *[F.expr(f"percentile_approx(v{n}, {ends}, {SKETCH})").alias(f"q{n}") for n, _, ends in picks]
        ).first()
        tried = {s: (sketch[f"q{n}"][0], sketch[f"q{n}"][1]) for n, s in enumerate(open_spots)}
        counts = doubles.agg(
            *[
                expression
                for n, s in enumerate(open_spots)
                for expression in (
                    F.count_if(F.col(s[0]) < F.lit(float(tried[s][0]))).alias(f"b{n}"),
                    F.count_if(within(s[0], *tried[s])).alias(f"i{n}"),
                )
            ]
        ).first()
        still = []
        for n, s in enumerate(open_spots):
            low, more = counts[f"b{n}"], counts[f"i{n}"]
            if low <= math.floor(position[s]) and math.ceil(position[s]) < low + more and more < inside[s]:
                brackets[s], below[s], inside[s] = tried[s], low, more
                if more > BRACKET_ROWS and tried[s][0] < tried[s][1]:
                    still.append(s)
        open_spots = still
    parts = [
        F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("spot"), F.lit(below[c, i]).alias("before"), F.col(c).alias("value")
        )
        for c, i in spots
    ]
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    if not parts:
        return names.select("column", *[F.lit(None).cast("double").alias(name_of(p)) for p in probabilities])
    marked = [F.when(within(c, *brackets[c, i]), part) for (c, i), part in zip(spots, parts, strict=True)]
    near = (
        doubles.select(F.explode(F.array_compact(F.array(*marked))).alias("x"))
        .select("x.*")
        .groupBy("column", "spot", "before", "value")
        .agg(F.count("*").alias("n"))
    )
    running = Window.partitionBy("column", "spot").orderBy("value")
    ranked = near.withColumn("upto", F.col("before") + F.sum("n").over(running))

    def value_at(i: int, which) -> Column:
        rank = F.lit(None).cast("bigint")
        for c in cols:
            if (c, i) in position:
                rank = F.when(F.col("column") == c, F.lit(which(position[c, i]))).otherwise(rank)
        hit = (F.col("spot") == i) & (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(hit, F.col("value")))

    picks = []
    for i in range(len(probabilities)):
        picks += [value_at(i, math.floor).alias(f"lo{i}"), value_at(i, math.ceil).alias(f"hi{i}")]
    found = ranked.groupBy("column").agg(*picks)
    out = [F.col("column")]
    for i, p in enumerate(probabilities):
        part = F.lit(0.0)
        for c in cols:
            if (c, i) in position:
                part = F.when(F.col("column") == c, F.lit(position[c, i] % 1)).otherwise(part)
        out.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part).alias(name_of(p)))
    return names.join(F.broadcast(found.select(out)), "column", "left")


def name_of(p: float) -> str:
    return f"p{round(p * 100):02d}"
