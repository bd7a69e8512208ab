"""Readers and writers: `documents` is written in each raw format to the shared folder and read back."""

import uuid

from pyspark.sql import functions as F

from tokenmill.functions import text as T
from tokenmill.operators import sampling as S
from tokenmill.operators import vocab as V
from tokenmill.plans.registry import query
from tokenmill.plans.sqltext import words
from tokenmill.plans.tasks import QUESTIONS, _multirc, _squad
from tokenmill.session import shared_dir
from tokenmill.sources import readers as R
from tokenmill.sources import writers as W

FLAT = "replace(text, chr(10), ' ')"


def _folder(t):
    return f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"


def _ordered(df):
    """Rows in the order of their ids over all part files, for formats that count lines."""
    return df.repartitionByRange("doc_id").sortWithinPartitions("doc_id")


def _flat(t):
    """Documents with their line ends replaced, for formats of one document per line."""
    return t.documents.withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))


@query("src01_json_lines", "SELECT doc_id, text, lang FROM documents")
def _(t):
    path = _folder(t)
    lines = t.documents.select(F.explode(F.array(F.to_json(F.struct("doc_id", "text", "lang")), F.lit(""))).alias("value"))  # every other line is blank
    lines.write.text(path)
    return R.json_lines(t.spark, path, "doc_id BIGINT, text STRING, lang STRING")


@query(
    "src01_split_files",
    "SELECT doc_id, text, 'dev' AS part FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text, 'few-shot test' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, text, 'few-shot dev' FROM documents WHERE doc_id % 3 = 1",
)
def _(t):
    path = _folder(t)
    for file, rest in (("val.jsonl", 0), ("dev32.jsonl", 1)):
        t.documents.filter(F.col("doc_id") % 3 == rest).select("doc_id", "text").write.json(f"{path}/{file}")
    read = lambda split, few, part: R.split_lines(t.spark, path, split, "doc_id BIGINT, text STRING", few).withColumn("part", F.lit(part))
    return read("dev", False, "dev").unionByName(read("test", True, "few-shot test")).unionByName(read("dev", True, "few-shot dev"))


@query("src02_json_records", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def _(t):
    path = _folder(t)
    # A file holds one JSON document over several lines, here with the records of up to a thousand neighbouring ids.
    records = t.documents.groupBy(F.floor(F.col("doc_id") / 1000)).agg(F.collect_list(F.struct("source", "text")).alias("r"))
    document = F.concat(F.lit('{"RECORDS":\n'), F.to_json("r"), F.lit("\n}"))
    records.select(document.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = R.json_records(t.spark, path, "source: STRING, text: STRING")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src03_text_lines", "SELECT line AS text, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def _(t):
    path = _folder(t)
    t.documents.select(F.col("text").alias("value")).write.text(path)
    return R.text_lines(t.spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("src04_recursive_scan", "SELECT doc_id, text FROM documents")
def _(t):
    path = _folder(t)
    t.documents.select("doc_id", "text", F.col("lang").alias("folder"), F.col("source").alias("sub")).write.partitionBy("folder", "sub").json(path)
    return R.json_lines(t.spark, path, "doc_id BIGINT, text STRING", recursive=True)


@query("src05_labelled_csv", f"SELECT {FLAT} AS text, length(text)::INTEGER AS length, lang AS label FROM documents WHERE doc_id % 9 > 0")
def _(t):
    path = _folder(t) + ".tsv"
    rows = _flat(t).select(F.col("source"), F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("label"), F.col("text").alias("sentence"))
    rows.write.csv(path, sep="\t", header=True, encoding="ISO-8859-1", escape='"')
    return R.labelled_csv(t.spark, path, "sentence", "label")


@query("src06_labelled_json", "SELECT text, length(text)::INTEGER AS length, CASE WHEN doc_id % 4 = 0 THEN '-1' ELSE lang END AS label FROM documents")
def _(t):
    path = _folder(t)
    t.documents.select("text", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("label")).write.json(path)
    return R.labelled_json(t.spark, path, "text", "label")


@query("src07_plain_tsv", f"SELECT {FLAT} AS sentence1, source AS sentence2, lang AS gold_label, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents")
def _(t):
    path = _folder(t)
    lines = _ordered(_flat(t)).select(F.concat_ws("\t", "text", "source", "lang").alias("value"))
    lines.write.text(path)
    return R.plain_tsv(t.spark, path, ["sentence1", "sentence2", "gold_label"], header=False)


@query("src08_quoted_csv", "SELECT lang AS label, source AS headline, text AS body, row_number() OVER (ORDER BY doc_id) - 1 AS line_no FROM documents")
def _(t):
    path = _folder(t)
    _ordered(t.documents).select("lang", "source", "text").write.csv(path, quoteAll=True, escape='"')
    return R.quoted_csv(t.spark, path, ["label", "headline", "body"], multi_line=True)


PAIRS = f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, trim({FLAT}) AS source, lang || ' ' || source AS target FROM documents"


def _paired(t):
    path = _folder(t)
    ordered = _ordered(_flat(t).select("doc_id", "text", F.concat_ws(" ", "lang", "source").alias("target")))
    ordered.select(F.col("text").alias("value")).write.text(f"{path}.source")
    ordered.select(F.col("target").alias("value")).write.text(f"{path}.target")
    return R.paired_lines(t.spark, f"{path}.source", f"{path}.target")


@query("src09_paired_lines", PAIRS)
def _(t):
    return _paired(t)


@query("jon02_positional_join", f"SELECT count(*) AS n, 0::BIGINT AS unpaired FROM ({PAIRS})")
def _(t):
    pairs = _paired(t)
    return pairs.agg(F.count("*").alias("n"), F.sum((F.col("source").isNull() | F.col("target").isNull()).cast("bigint")).alias("unpaired"))


QA_FILE = 200  # articles of a file, which is read by one task as one row


def _qa_files(articles):
    """One JSON document for each QA_FILE ids. Articles are written as text where they lie: as text they take a fraction of the memory of nested arrays.

    Rows meet by the number of their file before they are collected, so no task collects the articles of all files that its input has rows of.
    """
    texts = articles.select(F.floor(F.col("doc_id") / QA_FILE).alias("file"), F.expr("substring(to_json(struct(data)), 10)").alias("value"))
    inner = F.expr("left(value, length(value) - 2)")  # {"data":[ and ]} are the file's
    files = texts.select("file", inner.alias("value")).repartition("file").groupBy("file").agg(F.array_join(F.collect_list("value"), ",").alias("value"))
    return files.select(F.concat(F.lit('{"data":['), "value", F.lit("]}")).alias("value"))


@query(
    "src10_nested_qa",
    f"WITH {QUESTIONS} SELECT doc_id || '-' || q AS id, question, (CASE WHEN (doc_id + q) % 3 = 0 THEN 0 ELSE len(aw) END)::INTEGER AS n_answers FROM answers",
)
def _(t):
    path = _folder(t)
    # A file holds one JSON document, here with the articles of neighbouring ids, up to QA_FILE of them.
    _qa_files(_squad(t, "doc_id")).write.option("maxRecordsPerFile", 1).text(path)
    data = R.nested_qa(t.spark, path)
    qas = data.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select(F.explode("p.qas").alias("qa"))
    return qas.select("qa.id", "qa.question", F.size("qa.answers").alias("n_answers"))


@query(
    "src11_sectioned_documents",
    f"SELECT doc_id::VARCHAR AS id, {FLAT.replace('text', 'trim(text)')} AS source, source || ' ' || lang AS target FROM documents WHERE doc_id % 2 = 0 AND text NOT LIKE '%' || chr(10) || ' %' AND text NOT LIKE '% ' || chr(10) || '%' AND text NOT LIKE '%' || chr(10) || chr(10) || '%'",
)
def _(t):
    path = _folder(t)
    clean = t.documents.filter("text not like '%\\n %' and text not like '% \\n%' and text not like '%\\n\\n%'")
    value = F.concat(
        F.col("doc_id").cast("string"), F.lit("\n[SN]URL[SN]\nhttp\n[SN]FIRST-SENTENCE[SN]\n"), "source", F.lit("\n"), "lang", F.lit("\n[SN]RESTBODY[SN]\n"), "text", F.lit("\n"))
    # The format has one small file per document; many of them share a file here, behind a separator.
    clean.select(value.alias("value")).write.option("lineSep", "\x1e").text(path)
    files = t.spark.read.option("lineSep", "\x1e").text(path).select(F.regexp_extract("value", r"^\d+", 0).alias("id"), "value")
    wanted = t.documents.filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"))
    return R.sections_of(files).join(wanted, "id", "left_semi")


def _dump(t):
    path = _folder(t)
    value = F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" url="x">\nTitle\n'), "text", F.lit("\n</doc>"))
    t.documents.select(value.alias("value")).write.text(path)
    return path


SENTS = "list_filter(string_split(regexp_replace({}, '([.?!])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')"


@query(
    "src12_article_dump",
    f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    kept AS (SELECT doc_id, rtrim(line, ' ') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line_no FROM raw WHERE rtrim(line, ' ') <> '')
    SELECT doc_id::VARCHAR AS article, line_no::INTEGER AS line_no, array_to_string({SENTS.format("line")}, '|') AS sentences FROM kept""",
)
def _(t):
    return R.articles(t.spark, _dump(t)).select("article", "line_no", F.array_join("sentences", "|").alias("sentences"))


@query("src13_reading_folders", f"WITH {QUESTIONS} SELECT doc_id::VARCHAR AS id, count(*) AS n_questions FROM answers GROUP BY doc_id")
def _(t):
    path = _folder(t)
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("article"), F.split("text", "\n").alias("questions"),
        F.array(F.array("lang")).alias("options"), F.array(F.lit("A")).alias("answers"))
    for level, part in (("middle", rows.filter("id % 2 = 0")), ("high", rows.filter("id % 2 = 1"))):
        part.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/{level}")
    read = R.json_lines(t.spark, [f"{path}/middle/*.txt", f"{path}/high/*.txt"], R.RACE_SCHEMA)
    return read.select("id", F.size("questions").cast("bigint").alias("n_questions"))


@query(
    "src14_relation_facts",
    "SELECT 'The text of ' || doc_id || ' is [Y].' AS text_a, lang AS answer FROM documents WHERE source IN ('src1', 'src2', 'src3')",
)
def _(t):
    path = _folder(t)
    relation = F.when(F.col("source") == "src1", "P101").when(F.col("source") == "src2", "P103").when(F.col("source") == "src3", "P17").otherwise("P0")
    facts = t.documents.select(relation.alias("relation"), F.col("doc_id").cast("string").alias("sub_label"), F.col("lang").alias("obj_label"))
    templates = facts.select("relation", F.lit("The text of [X] is [Y].").alias("template")).distinct()
    templates.write.json(f"{path}-relations")
    facts.write.partitionBy("relation").json(path)
    read = t.spark.read.schema("sub_label STRING, obj_label STRING, relation STRING").json(path)
    return R.facts_in_templates(read, R.json_lines(t.spark, f"{path}-relations", "relation STRING, template STRING"))


@query(
    "src15_multiple_choice_files",
    f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS idx, text AS inputs_pretokenized, array_to_string(string_split(text, chr(10)), '|') AS choices, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS label FROM documents",
)
def _(t):
    path = _folder(t)
    _ordered(t.documents).select(
        F.col("text").alias("inputs_pretokenized"), F.split("text", "\n").alias("choices_pretokenized"), F.when(F.col("doc_id") % 2 == 0, 1).alias("label")).write.json(path)
    return R.multiple_choice_files(t.spark, path, across=True).select("idx", "inputs_pretokenized", F.array_join("choices_pretokenized", "|").alias("choices"), "label")


@query("src16_run_results", "SELECT 'run=' || user_id AS run, round(max(value), 6) AS accuracy FROM events GROUP BY user_id")
def _(t):
    path = _folder(t)
    runs = t.events.groupBy("user_id").agg(F.max("value").alias("accuracy"), F.lit("validation").alias("type"))
    runs.withColumnRenamed("user_id", "run").repartition("run").write.partitionBy("run").json(path)
    return R.run_results(t.spark, path + "/*/*.json", ["accuracy"]).select("run", F.round("accuracy", 6).alias("accuracy"))


@query("snk01_write_once", f"SELECT doc_id, len({words('text')}) AS n FROM documents")
def _(t):
    path = _folder(t)
    tokens = t.documents.select("doc_id", T.split_words(F.col("text")).alias("tokens"))
    W.write_once(tokens, path)
    again = W.write_once(tokens.limit(0), path)  # the second call finds the data and leaves it
    return again.select("doc_id", F.size("tokens").cast("bigint").alias("n"))


@query("snk02_shards", "SELECT (row_number() OVER (ORDER BY md5('scatter|' || doc_id), doc_id) - 1) // ((SELECT count(*) + 7 FROM documents) // 8) AS shard, doc_id FROM documents")
def _(t):
    path = _folder(t)
    W.write_shards(S.scatter(t.documents.select("doc_id", "text"), ["doc_id"], 8).drop("pos"), path)
    return t.spark.read.parquet(path).select(F.col("shard").cast("bigint").alias("shard"), "doc_id")


def _with_metrics(t):
    labelled = _flat(t).select("doc_id", F.col("lang").alias("label"), "text")
    metrics = t.labels.select("doc_id", "quality", "toxic")
    return W.with_metrics(labelled, metrics, "doc_id", ["quality", "toxic"])


RESULTS = f"SELECT lang AS label, quality, toxic, {FLAT} AS text FROM documents JOIN labels USING (doc_id)"


@query("snk03_results_csv", RESULTS)
def _(t):
    path = _folder(t)
    W.write_results_csv(_with_metrics(t), path, "doc_id")
    return t.spark.read.schema("label STRING, quality INT, toxic INT, text STRING").csv(path, header=True, escape='"')


@query("snk03_results_json", RESULTS)
def _(t):
    path = _folder(t)
    W.write_results_json(_with_metrics(t), path, "doc_id")
    return t.spark.read.schema("label STRING, quality INT, toxic INT, text STRING").json(path)


@query("snk03_results_tight_json", f"SELECT label, count(*) AS n FROM ({RESULTS}) GROUP BY label")
def _(t):
    path = _folder(t)
    W.write_results_json(_with_metrics(t), path, "doc_id", loose=False)
    lines = t.spark.read.text(path).select(F.regexp_replace("value", r"^[\[,]|^\]$", "").alias("v")).filter("v <> ''")
    return lines.select(F.get_json_object("v", "$.label").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "snk04_last_split_text",
    f"""WITH s AS (SELECT {FLAT} AS text, row_number() OVER (ORDER BY md5('1234|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT text FROM s WHERE pos >= n - n // 10""",
)
def _(t):
    path = _folder(t)
    split = S.split_rows(t.documents.select("doc_id", "text"), ["doc_id"], S.parse_split("90,0,10"))
    encoded = split.filter("split = 'test'").select(V.decode_chars(V.encode_chars(F.col("text"))).alias("text"))
    W.write_documents(encoded, path)
    return R.text_lines(t.spark, path)


def _predictions(t):
    return t.labels.select(F.col("doc_id").alias("idx"), F.col("quality").alias("prediction"))


@query("snk05_label_predictions", "SELECT doc_id AS idx, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS label FROM labels")
def _(t):
    path = _folder(t)
    W.label_predictions(_predictions(t), ["bad", "good"]).write.json(path)
    return t.spark.read.schema("idx BIGINT, label STRING").json(path)


@query(
    "snk06_nested_predictions",
    f"""WITH {QUESTIONS}, a AS (SELECT doc_id, q, unnest(range(len(aw)))::INTEGER AS k, unnest(aw) AS answer FROM answers),
    qs AS (SELECT doc_id, q, '{{"idx":' || q || ',"answers":[' || string_agg('{{"idx":' || k || ',"label":' || length(answer) % 2 || '}}', ',' ORDER BY k) || ']}}' AS j FROM a GROUP BY doc_id, q)
    SELECT doc_id AS idx, '{{"questions":[' || string_agg(j, ',' ORDER BY q) || ']}}' AS passage FROM qs GROUP BY doc_id""",
)
def _(t):
    questions = _multirc(t).select(F.col("idx").alias("passage_idx"), F.explode("passage.questions").alias("q"))
    answers = questions.select("passage_idx", F.col("q.idx").alias("question_idx"), F.explode("q.answers").alias("a"))
    rows = answers.select("passage_idx", "question_idx", F.col("a.idx").alias("answer_idx"), F.col("a.label").alias("label"))
    numbers = ("question_idx", "answer_idx", "label")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(-1)) for c in numbers})  # of words that are there, so never null; the schema doesn't know
    path = _folder(t)
    W.nested_predictions(rows, order=("question_idx", "answer_idx")).write.json(path)
    return t.spark.read.text(path).select(F.get_json_object("value", "$.idx").cast("bigint").alias("idx"), F.get_json_object("value", "$.passage").alias("passage"))


@query("snk07_candidate_predictions", f"SELECT doc_id AS idx, {words('text')}[(doc_id % 3 + 1)::INT] AS label FROM documents WHERE len({words('text')}) >= 3")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("idx"), T.split_words(F.col("text")).alias("candidates"), (F.col("doc_id") % 3).cast("int").alias("prediction"))
    path = _folder(t)
    W.candidate_predictions(rows.filter(F.size("candidates") >= 3)).write.json(path)
    return t.spark.read.schema("idx BIGINT, label STRING").json(path)


@query("snk08_sorted_predictions", "SELECT doc_id AS idx, quality AS label FROM labels")
def _(t):
    path = _folder(t)
    W.label_predictions(_predictions(t), order=True).write.json(path)
    return t.spark.read.schema("idx BIGINT, label INT").json(path)


@query("snk09_span_predictions", "SELECT doc_id AS id, text AS answer FROM documents")
def _(t):
    path = _folder(t)
    W.span_predictions(t.documents.select(F.col("doc_id").alias("guid"), F.col("text").alias("prediction"))).write.json(path)
    return t.spark.read.schema("id BIGINT, answer STRING").json(path)


@query(
    "snk10_best_answers",
    """WITH raw AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    p AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN '' ELSE line END AS prediction FROM raw)
    SELECT doc_id, coalesce(arg_min(prediction, i) FILTER (WHERE prediction <> ''), '') AS prediction FROM p GROUP BY doc_id""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    blank = F.when(F.col("i") % 6 == 0, "N / A").otherwise("")
    return W.best_answers(lines.select("doc_id", "i", F.when(F.col("i") % 3 == 0, blank).otherwise(F.col("line")).alias("prediction")), "doc_id", "i")


@query(
    "snk10_parallel_text",
    f"SELECT row_number() OVER (ORDER BY lang, text, source) - 1 AS line_no, trim(text) AS prediction, lang || ' ' || source AS ref FROM (SELECT doc_id, lang, source, {FLAT} AS text FROM documents)",
)
def _(t):
    path = _folder(t)
    rows = _flat(t).select("lang", F.col("text").alias("prediction"), F.concat_ws(" ", "lang", "source").alias("ref"))
    W.write_parallel_text(rows, path, "lang")
    pairs = R.paired_lines(t.spark, f"{path}.hyps", f"{path}.refs")
    return pairs.select("line_no", F.col("source").alias("prediction"), F.col("target").alias("ref"))


@query(
    "snk11_word_frequencies",
    f"SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 1000",
)
def _(t):
    path = _folder(t)
    W.write_frequencies(V.word_frequencies(t.documents), path, 1000)
    return t.spark.read.schema("word STRING, n BIGINT").csv(path, sep="\t")


@query("snk12_saved_examples", "SELECT doc_id::VARCHAR AS guid, text AS text_a, lang AS label FROM documents")
def _(t):
    path = _folder(t)
    W.save_examples(t.documents.select(F.col("doc_id").cast("string").alias("guid"), F.col("text").alias("text_a"), F.col("lang").alias("label")), path)
    return W.load_examples(t.spark, path)


@query("jon04_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels.filter("quality = 1"), "doc_id", "left_semi")


@query("jon05_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")
