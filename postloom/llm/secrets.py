"""Secret scans, with how widely each candidate is owned across the corpus.

A scan of each text finds spans of three base kinds (assignments, access keys, long hex runs) and of
one weaker kind, ``opaque``: mixed runs of letters and digits of high entropy. Every candidate's
value is hashed, and the hashes are aggregated over the whole corpus by distinct repositories and
owners. A value of ``example_owners`` or more owners, or in ``example_repos`` or more repositories of
one owner, is a widely copied example; others look live. Base spans always stand; an opaque span is added only if its value looks live.

Counting takes three aggregations that all combine before their shuffle, so a value that occurs in
a third of all rows costs one row per task and owner. Values never leave the scan in clear.

Defined cases: a null or empty text has no spans; null owners count as one owner; a row without a
repository counts as a repository of its own, its exact copies as the same one; repeated rows each
get their row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import add_columns, fresh_name
from .shared import stored

KINDS = ("assign", "access", "hex")
OPAQUE = "opaque"
EXAMPLE_OWNERS = 3
#: Repositories of one owner from which on a value is an example.
EXAMPLE_REPOS = 10
REDACTED = "[secret]"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_HEX_BYTES = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_OPAQUE_BYTES = bytes(0x78 if b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") else 0x20 for b in range(256))
_ENTROPY = 3.5  # bits a character

SPAN = "struct<start:int,rank:int,end:int,kind:string,hash:string>"


def _entropy(value: str) -> float:
    shares = [n / len(value) for n in Counter(value).values()]
    return -sum(p * math.log2(p) for p in shares)


def _opaque(value: str) -> bool:
    return (
        any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and _entropy(value) >= _ENTROPY
    )


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` by start, then kind; opaque spans overlap no base span."""
    raw, found = text.encode("utf-8", "surrogatepass"), []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    if b"x" * 20 in raw.translate(_OPAQUE_BYTES):
        base = [(s, e) for _, s, e, _ in found]
        for m in _OPAQUE.finditer(text):
            if _opaque(m[0]) and all(m.end() <= s or e <= m.start() for s, e in base):
                found.append((OPAQUE, *m.span(), m[0]))
    ranks = {k: i for i, k in enumerate((*KINDS, OPAQUE))}
    return sorted(found, key=lambda x: (x[1], ranks[x[0]]))


def _scan() -> callable:
    ranks = {k: i for i, k in enumerate((*KINDS, OPAQUE))}
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("hash", pa.string())])
    )

    def compute(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for text in texts.to_pylist():
            rows.append(
                [
                    {
                        "start": s,
                        "rank": ranks[k],
                        "end": e,
                        "kind": k,
                        "hash": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(),
                    }
                    for k, s, e, v in candidates(text or "")
                ]
            )
        return [pa.array(rows, kind)]

    return compute


def ownership(found: DataFrame, owner_col: str, repo_col: str, spans_col: str, keys: list[str]) -> DataFrame:
    """``(hash, n_owners, n_repos, most_repos)`` of every candidate value; the last is of one owner."""
    seen = found.select(
        F.explode(F.array_distinct(F.col(f"{spans_col}.hash"))).alias("hash"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
        F.when(F.col(repo_col).isNull(), F.struct(*keys)).alias("row"),
    ).distinct()
    by_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.max("repos").alias("most_repos")
    )


def find(
    docs: DataFrame,
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
    example_repos: int = EXAMPLE_REPOS,
) -> tuple[DataFrame, list[str]]:
    """Scanned rows and the names of their key columns.

    Rows hold two key columns (hashes of the whole row), owner and repository, ``base`` and
    ``added`` (arrays of spans by start), ``counted`` (these spans with ``n_owners`` and ``n_repos``),
    ``n_live`` and ``n_examples``.
    """
    keys = [fresh_name("row_key_a", docs.columns), fresh_name("row_key_b", docs.columns)]
    whole = [F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)]
    inner = docs.select(
        *[h.alias(k) for h, k in zip(whole, keys, strict=True)],
        F.col(owner_col).alias("owner"),
        F.col(repo_col).alias("repo"),
        F.col(text_col).alias("scanned_text"),
    )
    scanned = stored(add_columns(inner, "scanned_text", f"found array<{SPAN}>", _scan).drop("scanned_text"), "secret-spans")
    counts = ownership(scanned, "owner", "repo", "found", keys)
    each = scanned.select(*keys, F.explode("found").alias("span")).withColumn("hash", F.col("span.hash"))
    live = (F.col("n_owners") < example_owners) & (F.col("most_repos") < example_repos)
    shown = F.struct("span.*", "n_owners", "n_repos")
    judged = (
        each.join(counts, "hash")
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_set(F.when(live & (F.col("span.kind") == OPAQUE), F.col("span")))).alias("added"),
            F.array_sort(F.collect_set(F.when(live | (F.col("span.kind") != OPAQUE), shown))).alias("counted"),
            F.size(F.collect_set(F.when(live, F.col("span")))).cast("bigint").alias("n_live"),
            F.size(F.collect_set(F.when(~live, F.col("span")))).cast("bigint").alias("n_examples"),
        )
    )
    base = F.filter("found", lambda s: s.kind != OPAQUE)
    nothing = F.array().cast(f"array<{SPAN}>")
    rows = scanned.join(judged, keys, "left").select(
        *keys,
        "owner",
        "repo",
        base.alias("base"),
        F.coalesce("added", nothing).alias("added"),
        "counted",
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_examples", F.lit(0)).alias("n_examples"),
    )
    return rows, keys


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def report(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per document: base spans by kind, their digest, and all spans as text.

    ``n_owners`` and ``n_repos`` have a figure for each of ``spans``, in the same order.
    """
    rows, _ = find(docs.select(id_col, "text", owner_col), owner_col=owner_col, repo_col=id_col)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint")

    return rows.select(
        F.col("repo").alias(id_col),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_examples",
        *[F.coalesce(F.array_join(F.col(f"counted.{c}").cast("array<string>"), ","), F.lit("")).alias(c) for c in ("n_owners", "n_repos")],
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = REDACTED, **options) -> DataFrame:
    """The documents with each span, base or added, replaced by ``mark``; other texts unchanged."""
    rows, keys = find(docs, text_col, **options)
    spans = fresh_name("secret_spans", docs.columns)
    hit = (
        rows.filter((F.size("base") > 0) | (F.size("added") > 0))
        .select(*keys, F.array_sort(F.concat("base", "added")).alias(spans))
        .dropDuplicates(keys)
    )
    keyed = docs.withColumn(keys[0], F.xxhash64(*docs.columns)).withColumn(
        keys[1], F.xxhash64(F.lit(1), *docs.columns)
    )
    joined = keyed.join(hit, keys, "left")
    # Walk the spans by start; overlapping ones are one mark.
    state = "struct<out:string,at:int>"
    text = F.col(text_col)
    walked = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")).cast(state),
        lambda acc, s: F.when(
            s.start >= acc.at,
            F.struct(
                F.concat(acc.out, text.substr(acc.at + 1, s.start - acc.at), F.lit(mark)).alias("out"),
                s.end.alias("at"),
            ),
        )
        .otherwise(F.struct(acc.out.alias("out"), F.greatest(acc.at, s.end).alias("at")))
        .cast(state),
        lambda acc: F.concat(acc.out, text.substr(acc.at + 1, F.length(text))),
    )
    return joined.withColumn(text_col, F.coalesce(F.when(F.col(spans).isNotNull(), walked), text)).select(docs.columns)
