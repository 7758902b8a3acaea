"""Compare a query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(_cell, value)) if isinstance(value, (list, tuple)) else value


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = Counter(tuple(_cell(row[i]) for i in order) for row in rows)
    return [names[i] for i in order], cells


def difference(df, sql: str, con) -> str | None:
    """What differs, or None."""
    got_names, got = _table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_names, want = _table([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        only = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} / {sum(want.values())}; only here {only[0]}; only SQL {only[1]}"
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as E
    from tests.conftest import make_session

    scale, wanted = sys.argv[1], sys.argv[2:]
    folder = f"{ROOT}/{scale}"
    spark, con, sql = make_session(), connect(folder), E.oracle_sql()
    failed = 0
    for name, build in E.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                problem = difference(df, sql[name], con)
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in sql else "rows"
        print(f"{name:34} {kind:5} {time.time() - start:6.2f}s {problem or 'ok'}"[:1800], flush=True)
        spark.catalog.clearCache()
    print("failed", failed)


if __name__ == "__main__":
    main()
