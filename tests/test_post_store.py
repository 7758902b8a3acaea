"""Posts by language and day: what is read, what is replaced."""

import datetime
import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from postloom.sources import post_store as PS

DAY = datetime.date(2023, 5, 1)


@pytest.fixture(scope="module")
def posts(spark):
    at = F.expr("timestamp_ntz '2023-05-01 00:00:00' + make_dt_interval(0, 0, id * 30)")
    lang = F.when(F.col("id") % 3 > 0, "es").when(F.col("id") % 2 == 0, "001")
    label = F.element_at(F.array(*map(F.lit, ("negativo", "neutro", "positivo"))), (F.col("id") % 3 + 1).cast("int"))
    rows = spark.range(400).select(
        "id",
        F.when(F.col("id") % 9 == 0, "").otherwise(lang).alias("lang"),
        F.when(F.col("id") != 7, at).alias("created_at"),
        label.alias("label_sentiment"),
    )
    return rows.cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_whole_store(spark, posts, tmp_path):
    path = str(tmp_path / "s")
    PS.write_posts(posts, path)
    assert rows(PS.read_posts(spark, path, posts.schema)) == rows(posts)
    assert rows(PS.read_posts(spark, path)) == rows(posts)
    PS.write_posts(posts.limit(0), path)
    assert PS.read_posts(spark, path, posts.schema).count() == 0


@pytest.mark.parametrize("period", PS.PERIODS)
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_wanted_posts(spark, posts, tmp_path, period, kind):
    path = str(tmp_path / "s")
    posts = posts.withColumn("created_at", F.col("created_at").cast(kind))
    PS.write_posts(posts, path, period=period)
    last = DAY + datetime.timedelta(days=2)
    got = PS.read_posts(spark, path, posts.schema, [None, "", "001"], DAY + datetime.timedelta(days=1), last, ["negativo"], period=period)
    day = F.to_date("created_at")
    want = posts.filter("lang IS NULL OR lang IN ('', '001')").filter("label_sentiment = 'negativo'")
    want = want.filter(day.between(DAY + datetime.timedelta(days=1), last))
    assert rows(got) == rows(want) and want.count() > 10
    for nothing in ({"langs": []}, {"labels": []}, {"langs": ["null"]}, {"last": datetime.date(2020, 12, 31)}):
        assert PS.read_posts(spark, path, posts.schema, period=period, **nothing).count() == 0
    assert PS.read_posts(spark, path, posts.schema, langs=["es"], period=period).filter("id = 7").count() == 1


def test_other_folders_are_not_opened(spark, posts, tmp_path, capsys):
    path = str(tmp_path / "s")
    PS.write_posts(posts, path)
    needed = f"{path}/part_lang=is-es/part_time=2023-05-02/"
    files = glob.glob(f"{path}/*/*/*.parquet")
    for name in files:
        if not name.startswith(needed):
            size = os.path.getsize(name)
            with open(name, "wb") as f:
                f.write(b"x" * size)
            crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
            os.path.exists(crc) and os.remove(crc)
    day = DAY + datetime.timedelta(days=1)
    got = PS.read_posts(spark, path, posts.schema, ["es"], day, day)
    assert rows(got) == rows(posts.filter((F.col("lang") == "es") & (F.to_date("created_at") == day)))
    assert 0 < len(glob.glob(f"{needed}*.parquet")) < len(files)
    with pytest.raises(Exception, match="parquet|Parquet"):
        PS.read_posts(spark, path, posts.schema, ["es"]).count()
    capsys.readouterr()
    PS.read_posts(spark, path, posts.schema, labels=["neutro"]).explain("formatted")
    assert "EqualTo(label_sentiment,neutro)" in capsys.readouterr().out


def test_files_are_sorted_by_label(spark, posts, tmp_path):
    path = str(tmp_path / "s")
    PS.write_posts(posts.repartition(7), path)
    for name in glob.glob(f"{path}/*/*/*.parquet"):
        labels = pq.ParquetFile(name).read(["label_sentiment"]).column(0).to_pylist()
        assert labels == sorted(labels)


def test_touched_folders_are_replaced(spark, posts, tmp_path):
    path = str(tmp_path / "s")
    PS.write_posts(posts, path)
    day = posts.filter(F.to_date("created_at") == DAY)
    for _ in range(2):  # a repeated load leaves one copy
        PS.write_posts(day.withColumn("label_sentiment", F.lit("neutro")), path, replace="touched")
    got = PS.read_posts(spark, path, posts.schema)
    assert got.count() == posts.count()
    assert got.filter(F.to_date("created_at") == DAY).filter("label_sentiment <> 'neutro'").count() == 0


def test_refused(spark, posts, tmp_path):
    for kw in ({"period": "hour"}, {"replace": "some"}):
        with pytest.raises(ValueError):
            PS.write_posts(posts, str(tmp_path / "s"), **kw)
    with pytest.raises(ValueError):
        PS.write_posts(posts.withColumn("Part_Lang", F.lit(1)), str(tmp_path / "s"))
    PS.write_posts(posts.drop("lang"), str(tmp_path / "s"))
    assert PS.read_posts(spark, str(tmp_path / "s"), langs=[None]).count() == posts.count()
