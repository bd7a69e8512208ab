"""Row and sentence filters that need more than one predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.text import split_words


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def drop_redundant_sentences(df: DataFrame, key: str, rate: float, min_words: int = 5) -> DataFrame:
    """Drop short sentences, then those whose distinct words were mostly seen earlier in the same text.

    `df` has (key, pos, sentence). Dropped sentences still count as history, so "seen before" is simply "the word's first
    position lies earlier". Words are hashed with their text, so one huge text spreads over all tasks.
    """
    kept = df.filter(F.size(split_words(F.col("sentence"))) >= min_words)
    words = kept.select(key, "pos", F.explode(F.array_distinct(split_words(F.lower("sentence")))).alias("word"))
    first = F.min("pos").over(Window.partitionBy(key, "word"))
    share = words.select(key, "pos", (first < F.col("pos")).cast("int").alias("seen")).groupBy(key, "pos").agg(
        F.sum("seen").alias("seen"), F.count("*").alias("total"))
    fresh = share.filter(F.col("seen") <= F.lit(rate) * F.col("total")).select(key, "pos")
    return kept.join(fresh, [key, "pos"]).select(key, "pos", "sentence")
