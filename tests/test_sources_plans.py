import datetime
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from postloom.config import PreprocessConfig
from postloom.operators.report import activity
from postloom.plans.preprocess import Outputs, human_agreement, run
from postloom.plans.report import load_report_inputs
from postloom.session import shared_dir
from postloom.sources import corpus, delimited
from postloom.sources.fingerprint import dataset_fingerprint
from postloom.streaming.activity import stream_activity, stream_corpus


def test_raw_csv(spark, tmp_path):
    text = (
        "a,b,c\n"
        "1,x\n"
        "2,x,True\n"
        "3,x,y,z\n"
        "4,x,False,\n"
        '5,"p, ""q""\nr",False\n'
        '6,"a,b,c,d",NA\n'
        "7,x,y,,w\n"
        "8,ñ,maybe\n"
    )
    (tmp_path / "raw.csv").write_text(text, encoding="utf-8")
    df = delimited.read_raw_csv(spark, str(tmp_path / "raw.csv"), "a int, b string, c boolean", multi_line=True)
    assert [tuple(r) for r in df.orderBy("a").collect()] == [
        (1, "x", None), (2, "x", True), (5, 'p, "q"\nr', False), (6, "a,b,c,d", None), (8, "ñ", None),
    ]
    # Leaving columns out must not change which rows count as malformed.
    assert [r["a"] for r in df.select("a").orderBy("a").collect()] == [1, 2, 5, 6, 8]
    assert df.count() == 5


def test_corpus_keeps_letters_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("ñandú 🔥", None)], "full_text string, lang string").coalesce(1)
    corpus.write_corpus(df, str(tmp_path / "c"))
    line = next((tmp_path / "c").glob("part-*")).read_text(encoding="utf-8").strip()
    assert line == '{"full_text":"ñandú 🔥","lang":null}'
    assert corpus.read_corpus(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()


def test_sheet_arrays_and_quotes(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', ["x", "y"], "")], "t string, tokens array<string>, m string")
    df = df.coalesce(1)
    delimited.write_table_csv(df, str(tmp_path / "s"))
    text = next((tmp_path / "s").glob("part-*")).read_text()
    assert text.splitlines() == ["t,tokens,m", '"a ""b"", c","[""x"",""y""]",']


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("t", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")))
    first = dataset_fingerprint(df).first()
    assert first == dataset_fingerprint(df.repartition(5).select("t", "id")).first()
    assert first != dataset_fingerprint(df.withColumn("id", F.col("id") + 1)).first()


def test_fingerprint_after_write(spark, tmp_path):
    df = spark.range(50).withColumn("t", F.col("id").cast("string"))
    corpus.write_corpus(df, str(tmp_path / "c"))
    assert dataset_fingerprint(corpus.read_corpus(spark, str(tmp_path / "c"), df.schema)).first() == (
        dataset_fingerprint(df).first()
    )


@pytest.fixture(scope="module")
def canonical(spark):
    return spark.range(90).select(
        F.sha2(F.col("id").cast("string"), 256).alias("tweet_id_hashed"),
        F.concat(F.lit("#Gol "), F.expr("element_at(array('feliz 😂', 'robo asco', 'hoy'), int(id % 3) + 1)"),
                 F.lit(" "), "id").alias("full_text"),
        F.lit("es").alias("lang"),
        F.concat(F.lit("Sun Dec 11 18:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"),
                 F.lit(":00 +0000 2022")).alias("created_at"),
    )


def test_whole_run(spark, canonical, tmp_path):
    out = Outputs(*[str(tmp_path / n) for n in ("corpus", "sample", "validation", "log")])
    config = PreprocessConfig(sample_size=20, validation_size=30, lemmatize=True)
    lemmas = spark.createDataFrame([("gol", "GOL")], "form string, lemma string")
    stored = run(canonical, out, config, lemmas)
    assert stored.count() == 90
    lines = [x for f in (tmp_path / "corpus").glob("part-*") for x in f.read_text().splitlines()]
    row = json.loads(lines[0])
    assert row["clean_text"].startswith("gol ") and row["tokens"][0] == "GOL"
    counts = {r["label_sentiment"]: r["count"] for r in stored.groupBy("label_sentiment").count().collect()}
    assert counts == {"positivo": 30, "negativo": 30, "neutro": 30}
    lines = [x for f in (tmp_path / "log").glob("part-*") for x in f.read_text().splitlines()]
    assert "Total records: 90" in lines and any(x.startswith("Cohen's Kappa: ") for x in lines)
    sheet = spark.read.csv(out.validation, header=True)
    assert sheet.count() == 30 and sheet.columns[-1] == "label_manual"
    assert spark.read.csv(out.sample, header=True, escape='"').count() == 20

    metrics = spark.createDataFrame([("NB", 0.1, 0.2, 0.3)], delimited.METRICS_SCHEMA)
    delimited.write_table_csv(metrics, str(tmp_path / "m"))
    inputs = load_report_inputs(spark, out.corpus, str(tmp_path / "m"), str(tmp_path / "m"), stored.schema)
    assert inputs.posts.filter(F.hour("created_at") == 18).count() == 90
    assert inputs.base_metrics.collect() == metrics.collect()

    batch = {tuple(r) for r in activity(inputs.posts).collect()}
    stream = stream_activity(stream_corpus(spark, out.corpus, stored.schema))
    query = (
        stream.writeStream.outputMode("complete").format("memory").queryName("counts")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = {(t.replace(tzinfo=None), k, n) for t, k, n in map(tuple, spark.table("counts").collect())}
    assert got == batch


def test_epoch_times(spark, tmp_path):
    at = datetime.datetime(2022, 12, 11, 18, 0, 0, 123456)
    df = spark.createDataFrame([(at,)], "created_at timestamp_ntz")
    assert corpus.with_epoch_times(df).first()[0] == 1670781600123


def fake_session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "/warehouse"}
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key) or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_dir_follows_the_session(tmp_path):
    assert shared_dir(fake_session("yarn", str(tmp_path)), "x").startswith(str(tmp_path))
    assert shared_dir(fake_session("local[2]"), "x").startswith("/warehouse/")
    with pytest.raises(ValueError):
        shared_dir(fake_session("yarn"), "x")


def test_agreement_with_people(spark):
    posts = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "id int, label_sentiment string")
    sheet = posts.withColumn("label_manual", F.when(F.col("id") < 30, F.col("label_sentiment")).otherwise(" "))
    row = human_agreement(posts, sheet.drop("label_sentiment"), "id").first()
    assert row["kappa"] == 1.0 and row["n"] == 30


def test_fingerprint_tells_cells_apart(spark):
    a = spark.createDataFrame([("x", "yz")], "a string, b string")
    b = spark.createDataFrame([("xy", "z")], "a string, b string")
    assert dataset_fingerprint(a).first() != dataset_fingerprint(b).first()
