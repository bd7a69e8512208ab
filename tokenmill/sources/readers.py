"""Scans of raw corpora and benchmark files. Schemas are given, never inferred, so no scan reads its input twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.text import sentences
from tokenmill.operators.sequences import sections
from tokenmill.sources.quoted import quoted_table

MISSING_LABEL = "-1"  # fixed value: label of rows without one

# Relations of the fact-completion set.
RELATIONS = [
    "P1001", "P101", "P103", "P106", "P108", "P127", "P1303", "P131", "P136", "P1376", "P138", "P140", "P1412", "P159",
    "P17", "P176", "P178", "P19", "P190", "P20", "P264", "P27", "P276", "P279", "P30", "P31", "P36", "P361",
    "P364", "P37", "P39", "P407", "P413", "P449", "P463", "P47", "P495", "P527", "P530", "P740", "P937",
]


INPUT_PARTITIONS = "spark.tokenmill.inputPartitions"


def spread(df: DataFrame) -> DataFrame:
    """The scan as it is, or in as many partitions as the session asks for by INPUT_PARTITIONS.

    The setting is for tables of one row group, such as the bench's, which a scan can't split.
    """
    asked = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(asked)) if asked else df


def numbered(df: DataFrame, out: str = "line_no", across: bool = False) -> DataFrame:
    """Add the file name and the 0-based row number inside the file to a freshly scanned file source.

    A file is read in blocks, each by one task in file order. The number is the size of the blocks before plus the place in
    the block, so nothing is sorted and no task sees more than its block. With `across`, part files (shorter names first, then by
    name) count as one file.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    sizes = rows.groupBy("file", "__block").agg(F.count("*").alias("__n"))
    # One row per file block.
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "__block", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if across:
        # One row per file.
        earlier = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
        files = sizes.groupBy("file").agg(F.sum("__n").alias("__rows"))
        files = files.select("file", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__files"))
        sizes = sizes.join(files, "file").withColumn("__before", F.col("__before") + F.col("__files")).drop("__files")
    first = F.min("__id").over(Window.partitionBy("file", "__block"))
    rows = rows.withColumn("__place", F.col("__id") - first).join(sizes.drop("__n"), ["file", "__block"])
    return rows.withColumn(out, F.col("__before") + F.col("__place")).drop("__block", "__id", "__place", "__before")


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: str, recursive: bool = False) -> DataFrame:
    """One JSON object per line; blank lines give no row."""
    rows = spark.read.schema(f"{schema}, _bad STRING").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", recursive)
    df = rows.json(path)
    return df.filter(F.coalesce(F.trim("_bad"), F.lit("x")) != "").drop("_bad")


# File of each split, and the files that few-shot runs use instead.
SPLIT_FILES = {"train": "train.jsonl", "dev": "val.jsonl", "test": "test.jsonl", "unlabeled": "unlabeled.jsonl"}
FEW_SHOT_FILES = {"train": "train.jsonl", "dev": "dev32.jsonl", "test": "val.jsonl", "unlabeled": "unlabeled.jsonl"}


def split_lines(spark: SparkSession, folder: str, split: str, schema: str, few_shot: bool = False) -> DataFrame:
    """The JSON rows of a benchmark's split."""
    return json_lines(spark, f"{folder}/{(FEW_SHOT_FILES if few_shot else SPLIT_FILES)[split]}", schema)


def json_records(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """One JSON document whose RECORDS array holds the rows."""
    df = spark.read.schema(f"RECORDS ARRAY<STRUCT<{row_schema}>>").option("multiLine", True).json(path)
    return df.select(F.explode("RECORDS").alias("r")).select("r.*")


def text_lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """One document per line; without the line ends."""
    return spark.read.option("recursiveFileLookup", recursive).text(path).select(F.col("value").alias("text"))


def labelled_csv(spark: SparkSession, path: str, text: str, label: str | None, sep: str = ",", multi_line: bool = False, preprocess: Callable[[Column], Column] | None = None) -> DataFrame:
    """Text and label columns of a latin-1 table, found by their names; `.tsv` in the path means tabs, rows with nulls are dropped.

    Of several files, all must have the columns in the same order; others are an error.

    `preprocess` is a hook on the text, as a column expression.
    """
    sep = "\t" if ".tsv" in path else sep
    df = spark.read.csv(path, sep=sep, header=True, enforceSchema=False, encoding="ISO-8859-1", multiLine=multi_line, escape='"')
    value = F.col(label) if label in df.columns else F.lit(MISSING_LABEL)
    df = df.select(F.col(text).alias("text"), value.alias("label")).dropna()
    if preprocess:
        df = df.withColumn("text", preprocess(F.col("text")))
    return df.select("text", F.length("text").alias("length"), "label")


def labelled_json(spark: SparkSession, path: str, text: str, label: str, loose: bool = True) -> DataFrame:
    """Text and label of JSON rows, one per line (loose) or in one array (tight); a missing label is -1."""
    schema = f"`{text}` STRING, `{label}` STRING"
    df = json_lines(spark, path, schema) if loose else spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(F.col(text).alias("text"), F.length(text).alias("length"), F.coalesce(label, F.lit(MISSING_LABEL)).alias("label"))


def plain_tsv(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """Tab-separated strings without quoting or null markers, numbered by row; a header names the columns, otherwise their order does."""
    plain = spark.read if header else spark.read.schema(", ".join(f"`{c}` STRING" for c in columns))
    df = plain.csv(path, sep="\t", header=header, enforceSchema=not header, quote="", nullValue="\u0000", emptyValue="")
    return numbered(df, across=True).fillna("", list(columns)).select(*columns, "line_no")


def quoted_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Headerless quoted table of a fixed number of string columns, numbered by row; `multi_line` if fields hold line ends."""
    if multi_line:
        return quoted_table(spark, path, columns).fillna("", list(columns))
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    return numbered(spark.read.schema(schema).csv(path, escape='"'), across=True).fillna("", list(columns)).drop("file")


def paired_lines(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Line i of one file with line i of the other; a line without a partner keeps a null side (see `unpaired`).

    The part files of a side count as one.
    """
    lines = lambda path, name: numbered(spark.read.text(path), across=True).select("line_no", F.trim("value").alias(name))
    return lines(source, "source").join(lines(target, "target"), "line_no", "full")


def unpaired(pairs: DataFrame) -> DataFrame:
    """Lines that the other file lacks; none when the counts match."""
    return pairs.filter(F.col("source").isNull() | F.col("target").isNull())


QA_SCHEMA = (
    "data ARRAY<STRUCT<paragraphs: ARRAY<STRUCT<context: STRING, qas: ARRAY<STRUCT<id: STRING, question: STRING, "
    "answers: ARRAY<STRUCT<text: STRING, answer_start: INT>>>>>>>>"
)


def nested_qa(spark: SparkSession, path: str) -> DataFrame:
    """Articles with paragraphs, questions and answers in one JSON document per file."""
    return spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)


def _file_id(extension: str) -> Column:
    return F.regexp_extract("_metadata.file_path", rf"([^/]+)\.{extension}$", 1)


def sections_of(files: DataFrame) -> DataFrame:
    """Source and target texts of section-marked documents `(id, value)`: the rest of the body, and the first sentence."""
    blocks = F.transform(F.filter(F.split("value", r"(?m)^\s*\[SN\]"), lambda b: F.contains(b, F.lit("[SN]"))), lambda b: F.split(b, r"\[SN\]", 2))
    body = lambda b: F.array_join(F.filter(F.transform(F.split(b[1], "\n"), lambda line: F.trim(line)), lambda line: line != ""), " ")
    named = files.select("id", F.transform(blocks, lambda b: F.struct(b[0].alias("name"), body(b).alias("text"))).alias("s"))
    last = lambda name: F.try_element_at(F.filter("s", lambda s: s["name"] == name), F.lit(-1))["text"]
    return named.select("id", last("RESTBODY").alias("source"), last("FIRST-SENTENCE").alias("target"))


def sectioned_documents(spark: SparkSession, folder: str, id_file: str, split: str, extension: str = "summary") -> DataFrame:
    """Texts of the files whose ids are listed for a split, numbered in list order."""
    schema = "train ARRAY<STRING>, validation ARRAY<STRING>, test ARRAY<STRING>"
    wanted = spark.read.schema(schema).option("multiLine", True).json(id_file).select(F.posexplode("validation" if split == "dev" else split).alias("line_no", "id"))
    files = spark.read.text(f"{folder}/*.{extension}", wholetext=True).select(_file_id(extension).alias("id"), "value")
    return sections_of(files).join(wanted, "id").select("line_no", "id", "source", "target")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a `<doc id=…> … </doc>` dump as (article, line_no, sentences), without the title line."""
    parts = spark.read.option("lineSep", "</doc>").text(path).filter(F.contains("value", F.lit("<doc id=")))
    body = F.regexp_replace("value", r"(?s)^.*<doc id=[^\n]*\n", "")
    rows = parts.select(
        F.regexp_extract("value", r'<doc id="?([^\s">]*)', 1).alias("article"),
        F.filter(F.transform(F.split(body, "\n"), lambda line: F.rtrim(line)), lambda line: line != "").alias("lines"))
    return rows.select("article", F.posexplode("lines").alias("line_no", "line")).filter("line_no > 0").select(
        "article", "line_no", sentences(F.col("line")).alias("sentences"))


def article_sections(spark: SparkSession, path: str) -> DataFrame:
    """Key sentences and contents of every article of a dump."""
    return sections(articles(spark, path), "article")


RACE_SCHEMA = "id STRING, article STRING, questions ARRAY<STRING>, options ARRAY<ARRAY<STRING>>, answers ARRAY<STRING>"


def reading_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with questions from the `middle` and `high` folders of a split."""
    return json_lines(spark, [f"{folder}/middle/*.txt", f"{folder}/high/*.txt"], RACE_SCHEMA)


def facts_in_templates(facts: DataFrame, templates: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Subjects put into the template of their relation; only the listed relations are kept."""
    known = templates.filter(F.col("relation").isin(RELATIONS))
    joined = facts.join(F.broadcast(known), "relation")  # at most one row per listed relation
    return joined.select(*keep, F.replace("template", F.lit("[X]"), F.col("sub_label")).alias("text_a"), F.col("obj_label").alias("answer"))


def relation_facts(spark: SparkSession, folder: str, relation_file: str, set_type: str) -> DataFrame:
    """Facts of one file per relation, numbered by line: (guid, text_a, answer)."""
    templates = json_lines(spark, relation_file, "relation STRING, template STRING")
    facts = numbered(spark.read.schema("sub_label STRING, obj_label STRING").json(f"{folder}/*/{set_type}.jsonl"))
    facts = facts.withColumn("relation", F.regexp_extract("file", rf"([^/]+)/{set_type}\.jsonl$", 1))
    guid = F.concat_ws("-", F.lit(set_type), "relation", F.col("line_no").cast("string"))
    return facts_in_templates(facts.withColumn("guid", guid), templates, ["guid"])


def multiple_choice_files(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """Inputs, choices and label (default 0) per line, with the file and the line number as id (over all part files with `across`)."""
    df = spark.read.schema("inputs_pretokenized STRING, choices_pretokenized ARRAY<STRING>, label INT").json(path)
    return numbered(df, across=across).select("file", F.col("line_no").cast("string").alias("idx"), "inputs_pretokenized", "choices_pretokenized", F.coalesce("label", F.lit(0)).alias("label"))


def run_results(spark: SparkSession, pattern: str, metrics: Sequence[str]) -> DataFrame:
    """Validation results of all runs under a glob such as `runs/*/results.json`; runs without the file do not appear."""
    schema = ", ".join(f"`{m}` DOUBLE" for m in metrics) + ", type STRING, epoch INT"
    run = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return spark.read.schema(schema).json(pattern).select(run.alias("run"), "*")
