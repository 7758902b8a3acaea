"""Text columns of a corpus: clean text, tokens, lemmas, hashtags, media flags."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PreprocessConfig
from ..functions import text as X
from .blocks import packed, unpacked
from .bounded import lookup_dict, lookup_join, settled, stored_once

# Each Python worker holds its own copy of the table, several times its size as text.
ROW_LOOKUP_BYTES = 16 * 1024 * 1024
# A block is one row of some megabytes: row groups are closed by their size after each row.
BLOCK_FILES = {
    "compression": "zstd",
    "parquet.block.size": 16 * 1024 * 1024,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}


def with_clean_text(
    df: DataFrame,
    config: PreprocessConfig = PreprocessConfig(),
    text: str = "full_text",
    out: str = "clean_text",
) -> DataFrame:
    """The whole cleaning chain, in three projections.

    The emoji step reads its input several times; as a column of its own that input is computed
    once per row.
    """
    source, tagged, worded = F.col(text), F.col("__tagged"), F.col("__worded")
    if config.null_text == "literal":
        source = F.coalesce(source, F.lit("None"))
    bare = X.strip_mentions(X.strip_urls(F.lower(X.nfkc(source))))
    words = X.join_compounds(worded, config.compounds)
    return (
        df.withColumn("__tagged", X.hashtags(bare, config.hashtag_strategy))
        .withColumn("__worded", X.emojis(tagged, config.emoji_strategy))
        .withColumn(out, X.squeeze(X.split_hyphens(words)))
        .drop("__tagged", "__worded")
    )


def with_tokens(df: DataFrame, text: str = "clean_text", out: str = "tokens") -> DataFrame:
    return df.withColumn(out, X.tokens(F.col(text)))


def with_lemmas(
    df: DataFrame,
    lemmas: DataFrame,
    tokens: str = "tokens",
    out: str = "tokens",
    row_bytes: int = ROW_LOOKUP_BYTES,
    **join_options: int,
) -> DataFrame:
    """Replace each token by its lemma from a ``(form, lemma)`` table.

    Of several lemmas of a form the smallest counts. Forms that occur are looked up inside each row,
    in Arrow batches, while they are measured below ``row_bytes``. Beyond, rows are stored in blocks; each
    form of a block is joined once, as ``lookup_join`` sees fit, and the lemmas found go to the blocks.
    """
    table = settled(lemmas.select("form", "lemma").filter(F.col("lemma").isNotNull()), "form", "lemma")
    table = stored_once(table, "settled")
    words = df.select(F.explode(tokens).alias("form"))
    forms = lookup_dict(words, table, "form", "lemma", row_bytes)
    if forms is not None:
        replace = _lemma_function(df.sparkSession.sparkContext.broadcast(forms))
        return df.withColumn(out, replace(tokens))
    whole = df.withColumn(out, F.col(tokens).cast("array<string>"))
    blocks = packed(whole, out).withColumn("__block", F.monotonically_increasing_id())
    blocks = stored_once(blocks, "blocks", **BLOCK_FILES)
    listed = blocks.select("__block", F.posexplode("forms").alias("at", "form"))
    looked = lookup_join(listed, table, "form", **join_options).filter(F.col("lemma").isNotNull())
    found = looked.groupBy("__block").agg(F.collect_list(F.struct("at", "lemma")).alias("found"))
    joined = lookup_join(blocks, stored_once(found, "found"), "__block", **join_options)
    return unpacked(joined, whole.schema, out)


def _lemma_function(forms: Broadcast):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def replace(lists: pa.Array) -> pa.Array:
        # Each distinct token of the batch is looked up once.
        coded = lists.flatten().dictionary_encode()
        found = [(w, forms.value.get(w)) for w in coded.dictionary.to_pylist()]
        words = [w if lemma is None else lemma for w, lemma in found]
        values = pa.array(words, pa.string()).take(coded.indices)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())

    return replace


def with_hashtags(
    df: DataFrame, text: str = "full_text", out: str = "extracted_hashtags"
) -> DataFrame:
    return df.withColumn(out, X.extract_hashtags(F.col(text)))


def top_hashtags(df: DataFrame, k: int = 10, text: str = "full_text") -> DataFrame:
    """The most frequent hashtags, ties by name."""
    tags = df.select(F.explode(X.extract_hashtags(F.col(text))).alias("hashtag"))
    counts = tags.groupBy("hashtag").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "hashtag").limit(k)


def with_media_flags(df: DataFrame, text: str = "full_text") -> DataFrame:
    source = F.coalesce(F.col(text), F.lit("None"))
    return df.withColumns({"has_image": X.has_image(source), "has_video": X.has_video(source)})


def media_counts(df: DataFrame, text: str = "full_text") -> DataFrame:
    return with_media_flags(df, text).agg(
        F.count_if("has_image").alias("with_image"), F.count_if("has_video").alias("with_video")
    )
