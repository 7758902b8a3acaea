"""Encoding and decoding against the tokenizers library."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postloom.llm import bpe
from postloom.llm.packing import vocabulary_path

ODD = [
    "a <|endoftext|> b", "<|startoftext|>Ab<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "éx É ÉCOLE",
    "日本語のテキスト 한국어 العربية ไทย", "ΟΔΟΣ σας İstanbul ǅ ﬁ ½ ²3", "don't we'll I'VE 'S '", "😀👍🏽 x‍y ﻿ z",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "a b c\td\ne\r\nf\x0bg\x1ch\x85i", "12345 3.14 １２", "\x00\x01 ~!@#$%^&*()", "ᾳͅ Ạ̊",
]


@pytest.fixture(scope="module")
def path():
    return vocabulary_path()


@pytest.fixture(scope="module")
def model(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def judged(model, text):
    ids = model.encode(text or "", add_special_tokens=False).ids
    return ids, model.decode(ids, skip_special_tokens=False)


def test_equals_the_library(spark, corpus, path, model):
    texts = ODD + [r.text for r in corpus.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("mine")).repartition(3)
    encoded = bpe.encode(docs, path, decoded="at_once")
    got = {r.doc_id: r for r in bpe.decode(encoded, path, "_ids").collect()}
    assert encoded.columns == [*docs.columns, "_ids", "at_once"]
    for i, text in enumerate(texts):
        ids, decoded = judged(model, text)
        assert (got[i]["_ids"], got[i].decoded, got[i].at_once, got[i].ids) == (ids, decoded, decoded, "mine")


def test_random_texts(path, model):
    rng = random.Random(6)
    alphabet = ["a", "b", "the", "ing", "é", "ß", "Ω", "ы", "中", " ", "  ", "\n", "'", "s", "1", "!", "́", "😀", "‍", "<|endoftext|>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    words = bpe.Encoder(bpe.Vocabulary(path), kept=700)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], words.encode(texts[at : at + 100]), strict=True):
            assert ids.tolist() == judged(model, text)[0], repr(text)


def test_merges_of_any_word(path, model):
    rng = random.Random(7)
    words = list({"".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 30))) for _ in range(4000)})
    ids, count = bpe.merge_by_rank(bpe.Vocabulary(path), [w.encode() for w in words])
    at = 0
    for word, n in zip(words, count.tolist(), strict=True):
        assert ids[at : at + n].tolist() == model.encode(word).ids
        at += n
    assert at == len(ids)


def test_report(spark, corpus, nothing, path, model):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = corpus.withColumns({"id": F.lit("x"), "decoded": F.lit(1)})
    want = Counter()
    for r in corpus.collect():
        ids, text = judged(model, r.text)
        want[r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text)] += 1
    assert Counter(tuple(r) for r in bpe.report(docs).collect()) == want
    assert bpe.report(nothing).count() == 0


def test_decoding_awkward_lists(spark, path):
    rows = [(1, None), (2, []), (3, [320, None, 10**8, 49407])]
    got = bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), path)
    assert {r.k: r.decoded for r in got.collect()} == {1: "", 2: "", 3: "a</w> <|endoftext|>"}


def test_other_vocabularies_are_refused(tmp_path, path):
    parts = json.load(open(path, encoding="utf-8"))
    for change in ({"decoder": {"type": "ByteLevel"}}, {"model": parts["model"] | {"merges": parts["model"]["merges"][::-1]}}):
        file = tmp_path / "vocabulary.json"
        file.write_text(json.dumps(parts | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(file))
