"""Records of quoted CSV put together over byte ranges, against whole-file reading."""

import random
from collections import Counter

import pytest

from postloom.operators.curate import dedup_keep_first
from postloom.sources.delimited import read_raw_csv
from postloom.sources.split_csv import MAX_OPEN_RANGES, open_ranges, read_split_csv
from postloom.sources import split_csv

SCHEMA = "id bigint, text string, lang string"


def write_files(folder, seed, end="\n"):
    """Rows by file and line; fields hold line breaks, quotes and separators, some over many ranges."""
    rng, rows = random.Random(seed), []
    folder.mkdir()
    for n in range(3):
        lines = ["id,text,lang"]
        for i in range(60):
            words = rng.choices(["uno", "dos", 'di"jo', "a,b", "", "x\ny", "\n\n", "é日", '"', '""'], k=rng.choice([1, 4, 90, 900]))
            text = " ".join(words)
            rows.append((1000 * n + i, text))
            escaped = text.replace('"', '""')
            lines.append(f'{1000 * n + i},"{escaped}",es')
            if rng.random() < 0.1:
                lines.append("")
        (folder / f"part-{n}.csv").write_bytes((end.join(lines) + end * (n % 2)).encode())
    return rows


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_reading_whole_files(spark, tmp_path, small_ranges, seed):
    rows = write_files(tmp_path / "in", seed)
    path = str(tmp_path / "in")
    lines = split_csv._lines(spark, path)
    assert lines.rdd.getNumPartitions() > 30 and open_ranges(lines).count() > 5
    got = read_split_csv(spark, path, SCHEMA)
    assert rows_of(got) == rows_of(read_raw_csv(spark, path, SCHEMA, multi_line=True))
    assert {r.id: r.text for r in got.collect()} == {i: t or None for i, t in rows}


def test_positions_follow_the_files(spark, tmp_path, small_ranges):
    rows = write_files(tmp_path / "in", 3)
    found = read_split_csv(spark, str(tmp_path / "in"), SCHEMA, position="place")
    assert [r.id for r in found.orderBy("place").collect()] == [i for i, _ in rows]
    first = {}
    for i, text in rows:
        first.setdefault(text or None, i)
    kept = dedup_keep_first(found, "text", ["place"]).collect()
    assert {r.text: r.id for r in kept} == first


def test_other_line_ends_and_no_breaks(spark, tmp_path, small_ranges):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = ["id,text,lang"] + [f'{i},"text {i}",{"es" if i % 2 else "NA"}' for i in range(300)]
    (folder / "a.csv").write_bytes("\r\n".join(lines).encode())
    got = read_split_csv(spark, str(folder), SCHEMA)
    assert rows_of(got) == Counter({(i, f"text {i}", "es" if i % 2 else None): 1 for i in range(300)})


def test_many_open_ranges_are_read_whole(spark, tmp_path, small_ranges, monkeypatch):
    write_files(tmp_path / "in", 4)
    path = str(tmp_path / "in")
    want = rows_of(read_split_csv(spark, path, SCHEMA))
    assert MAX_OPEN_RANGES > 2
    monkeypatch.setattr(split_csv, "MAX_OPEN_RANGES", 2)
    assert rows_of(read_split_csv(spark, path, SCHEMA)) == want
    with pytest.raises(ValueError):
        read_split_csv(spark, path, SCHEMA, position="place")
