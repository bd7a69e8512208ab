"""Prepared corpora, predictions and reports out. Writers leave part files; an order only costs a sort where the format asks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.operators.prefix import position
from tokenmill.session import cut_lineage

NOT_ANSWERABLE = "n/a"


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Materialize a tokenized corpus unless it is there already, and read it back.

    Spark marks a finished write; a folder without the mark broke off and is written again.
    """
    spark = df.sparkSession
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard. Tasks take ranges of (shard, hash of the row), so a large shard has as many as its size asks for."""
    mixed = F.xxhash64(*[c for c, kind in df.dtypes if c != shard and not kind.startswith(("map", "array"))])
    df.repartitionByRange(F.col(shard), mixed).write.mode("errorifexists").partitionBy(shard).parquet(path)


def with_metrics(labelled: DataFrame, metrics: DataFrame, key: str, metric_names: Sequence[str]) -> DataFrame:
    """Label, metrics and text of every row, in that order."""
    return labelled.join(metrics, key).select(key, "label", *metric_names, "text")


def write_results_csv(rows: DataFrame, path: str, key: str, sep: str = ",") -> None:
    rows.drop(key).write.csv(path, header=True, sep=sep, quoteAll=False, escape='"')


def write_results_json(rows: DataFrame, path: str, key: str, loose: bool = True) -> None:
    """JSON objects, one per line; `loose=False` makes the part files, read in order, one JSON array."""
    if loose:
        rows.drop(key).write.json(path)
        return
    columns = [c for c in rows.columns if c != key]
    placed = position(rows, key, "__pos").select("__pos", F.to_json(F.struct(*columns)).alias("value"))
    lines = placed.select("__pos", F.concat(F.when(F.col("__pos") == 0, "[").otherwise(","), "value").alias("value"))
    closing = rows.agg(F.count("*").alias("__pos")).select("__pos", F.when(F.col("__pos") == 0, "[]").otherwise("]").alias("value"))
    lines.unionByName(closing).orderBy("__pos").select("value").write.text(path)


def write_documents(df: DataFrame, path: str, text: str = "text") -> None:
    """Decoded documents, one per line."""
    df.select(F.regexp_replace(text, r"\r?\n", " ").alias("value")).write.text(path)


def label_predictions(predictions: DataFrame, labels: Sequence[str] | None = None, order: bool = False) -> DataFrame:
    """(idx, label) rows; class numbers become label names where a task has them."""
    label = F.col("prediction") if labels is None else F.element_at(F.array(*map(F.lit, labels)), F.col("prediction") + 1)
    rows = predictions.select("idx", label.alias("label"))
    return rows.orderBy("idx") if order else rows


def nested_predictions(predictions: DataFrame, order: str | Sequence[str] = "pos") -> DataFrame:
    """One row per passage with its questions and their answers, both by first appearance in the order of one or more columns.

    The format holds a passage in one line, so the group is as large as the passage the answers came from. Rows are shuffled once, by passage,
    as one list for each column: numbers take their own width there. Questions are runs of the sorted answers.
    """
    order = [order] if isinstance(order, str) else list(order)
    columns = dict.fromkeys([*order, "question_idx", "answer_idx", "label"])
    # Lists leave out nulls, so a column that may hold them is wrapped; all lists of a passage are in one order.
    wrapped = {c for c in columns if predictions.schema[c].nullable}
    lists = [F.collect_list(F.struct(F.col(c).alias("v")) if c in wrapped else F.col(c)).alias(c) for c in columns]

    def whole(x: Column) -> Column:
        value = {c: x[c]["v"] if c in wrapped else x[c] for c in columns}
        place = F.struct(*[value[c].alias(c) for c in order])
        return F.struct(value["question_idx"].alias("q"), place.alias("o"), value["answer_idx"].alias("idx"), value["label"].alias("label"))

    answers = F.sort_array(F.transform(F.arrays_zip(*columns), whole))

    def questions(found: Column) -> Column:
        starts = A.positions_where(A.indices(found), lambda i: (i == 0) | ~F.get(found, i)["q"].eqNullSafe(F.get(found, i - 1)["q"]))

        def question(at: Column, k: Column, begun: Column) -> Column:
            own = A.take(found, at, F.coalesce(F.get(begun, k + 1), F.size(found)) - at)
            nested = F.struct(F.get(found, at)["q"].alias("idx"), F.transform(own, lambda x: F.struct(x["idx"], x["label"])).alias("answers"))
            return F.struct(F.get(found, at)["o"].alias("first"), nested.alias("q"))

        return A.let(starts, lambda begun: F.transform(F.sort_array(F.transform(begun, lambda at, k: question(at, k, begun))), lambda x: x["q"]))

    passages = predictions.groupBy("passage_idx").agg(*lists)
    return passages.select(F.col("passage_idx").alias("idx"), F.struct(A.let(answers, questions).alias("questions")).alias("passage"))


def candidate_predictions(predictions: DataFrame, candidates: str = "candidates") -> DataFrame:
    """(idx, label) where the label is the chosen candidate's text."""
    return predictions.select("idx", F.element_at(candidates, F.col("prediction") + 1).alias("label"))


def span_predictions(predictions: DataFrame, guid: str = "guid") -> DataFrame:
    return predictions.select(F.col(guid).alias("id"), F.col("prediction").alias("answer"))


def best_answers(predictions: DataFrame, key: str, order: str) -> DataFrame:
    """Per question the first non-empty answer; a not-answerable mark counts as empty."""
    blank = F.lower(F.replace("prediction", F.lit(" "), F.lit(""))) == NOT_ANSWERABLE
    text = F.when(blank, F.lit("")).otherwise(F.col("prediction"))
    first = F.min_by(F.when(text != "", text), F.when(text != "", F.col(order)))
    return predictions.groupBy(key).agg(F.coalesce(first, F.lit("")).alias("prediction"))


def write_parallel_text(examples: DataFrame, path: str, order: str) -> None:
    """Hypotheses, references and sources as parallel text folders: line i of all part files, in name order, belongs to row i.

    Rows are sorted once; equal keys go by their texts, and null texts are empty lines.
    """
    names = {name: column for name, column in (("hyps", "prediction"), ("refs", "ref"), ("source", "source")) if column in examples.columns}
    lines = [F.coalesce(F.regexp_replace(column, r"\r?\n", " "), F.lit("")).alias(name) for name, column in names.items()]
    rows = cut_lineage(examples.select(order, *lines).orderBy(order, *names))
    for name in names:
        rows.select(F.col(name).alias("value")).write.text(f"{path}.{name}")


def write_frequencies(frequencies: DataFrame, path: str, limit: int) -> None:
    """Word frequencies, most frequent first, capped at the size the trainer accepts."""
    frequencies.orderBy(F.col("n").desc(), "word").limit(limit).select("word", "n").write.csv(path, sep="\t")


def save_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("errorifexists").parquet(path)


def load_examples(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
