"""Readers, writers and the stream on small files with edge rows."""

import json
import random

from pyspark.sql import functions as F

from tokenmill.operators.sequences import sections
from tokenmill.plans.files import _qa_files
from tokenmill.sources import readers as R
from tokenmill.sources import writers as W
from tokenmill.streaming.ingest import ingest_corpus


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_json_lines_skip_blanks(spark, tmp_path):
    path = put(tmp_path / "a.json", '{"text": "x"}   \n\n   \n{"other": 1}\n')
    assert [r["text"] for r in R.json_lines(spark, path, "text STRING").collect()] == ["x", None]


def test_records(spark, tmp_path):
    path = put(tmp_path / "a.json", json.dumps({"RECORDS": [{"title": "t", "content": "c"}, {"title": None}]}, indent=1))
    assert [tuple(r) for r in R.json_records(spark, path, "title: STRING, content: STRING").collect()] == [("t", "c"), (None, None)]


def test_labelled_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'label,sentence\npos,"café, ""x"""\n,gone\nneg,ok\n', "latin-1")
    rows = R.labelled_csv(spark, path, "sentence", "label", preprocess=F.upper).collect()
    assert [(r["text"], r["length"], r["label"]) for r in rows] == [('CAFÉ, "X"', 9, "pos"), ("OK", 2, "neg")]
    path = put(tmp_path / "b.tsv", "sentence\nx y\n")
    assert R.labelled_csv(spark, path, "sentence", "label").first()["label"] == "-1"


def test_labelled_json_tight(spark, tmp_path):
    path = put(tmp_path / "a.json", json.dumps([{"sentence": "a", "label": "1"}, {"sentence": "b"}]))
    assert [r["label"] for r in R.labelled_json(spark, path, "sentence", "label", loose=False).collect()] == ["1", "-1"]


def test_plain_tsv_keeps_quotes_and_nulls(spark, tmp_path):
    path = put(tmp_path / "a.tsv", 'sentence\tlabel\n"open\tNA\nnull\t\n')
    rows = sorted(R.plain_tsv(spark, path, ["sentence", "label"]).collect(), key=lambda r: r["line_no"])
    assert [tuple(r) for r in rows] == [('"open', "NA", 0), ("null", "", 1)]
    assert [tuple(r) for r in R.plain_tsv(spark, path, ["label", "sentence"]).orderBy("line_no").collect()] == [("NA", '"open', 0), ("", "null", 1)]


def test_line_numbers_over_several_blocks(spark, tmp_path):
    path = put(tmp_path / "a.txt", "".join(f"line {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(path).select(F.col("_metadata.file_block_start")).distinct().count() > 3
        rows = {r["line_no"]: r["value"] for r in R.numbered(spark.read.text(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {i: f"line {i}" for i in range(5000)}


def test_paired_lines(spark, tmp_path):
    a, b = put(tmp_path / "a", "1\n2\n3\n"), put(tmp_path / "b", "x\ny\n")
    pairs = R.paired_lines(spark, a, b)
    assert sorted(tuple(r) for r in pairs.dropna().collect()) == [(0, "1", "x"), (1, "2", "y")]
    assert R.unpaired(pairs).count() == 1


def test_paired_lines_over_part_files(spark, tmp_path):
    for side in "ab":
        put(tmp_path / side / "part-1", f"{side}0\n{side}1\n")
        put(tmp_path / side / "part-2", f"{side}2\n{side}3\n")
    pairs = R.paired_lines(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(tuple(r) for r in pairs.collect()) == [(i, f"a{i}", f"b{i}") for i in range(4)]


def test_parallel_text_keeps_rows_together(spark, tmp_path):
    rows = [(k % 3, f"p{k}", f"r{k}") for k in range(60)]
    W.write_parallel_text(spark.createDataFrame(rows, "k int, prediction string, ref string").repartition(5), str(tmp_path / "x"), "k")
    got = R.paired_lines(spark, str(tmp_path / "x.hyps"), str(tmp_path / "x.refs")).orderBy("line_no").collect()
    assert [(r["source"], r["target"]) for r in got] == [(p, q) for _, p, q in sorted(rows)]


def test_sectioned_documents(spark, tmp_path):
    for i in (1, 2):
        put(tmp_path / f"{i}.summary", f"[SN]URL[SN]\nhttp://x\n[SN]FIRST-SENTENCE[SN]\n one {i} \n[SN]RESTBODY[SN]\nb1\n\n b2\n")
    ids = put(tmp_path / "ids.json", json.dumps({"train": ["9"], "validation": ["2"], "test": []}))
    rows = R.sectioned_documents(spark, str(tmp_path), ids, "dev").collect()
    assert [tuple(r) for r in rows] == [(0, "2", "b1 b2", "one 2")]


def test_article_dump(spark, tmp_path):
    text = '<doc id="7" url="u">\nTitle\n\nHead.\nSingle one.\nA b. C d. E.\nTail\n</doc>\n<doc id="8">\nT\nOnly\n</doc>\n'
    path = put(tmp_path / "wiki_00", text)
    rows = sorted(tuple(r) for r in sections(R.articles(spark, path), "article").select("article", "key_sentence", "content").collect())
    assert rows == [("7", "A b.", "C d. E. Tail"), ("7", "Head.", "Single one."), ("8", "Only", "")]


def test_relation_facts(spark, tmp_path):
    put(tmp_path / "d" / "P17" / "dev.jsonl", '{"sub_label": "A", "obj_label": "B"}\n{"sub_label": "C", "obj_label": "D"}\n')
    put(tmp_path / "d" / "P0" / "dev.jsonl", '{"sub_label": "A", "obj_label": "B"}\n')
    meta = put(tmp_path / "relations.jsonl", '{"relation": "P17", "template": "[X] is in [Y]."}\n{"relation": "P0", "template": "no"}\n')
    rows = sorted(tuple(r) for r in R.relation_facts(spark, str(tmp_path / "d"), meta, "dev").collect())
    assert rows == [("dev-P17-0", "A is in [Y].", "B"), ("dev-P17-1", "C is in [Y].", "D")]


def test_multiple_choice_and_run_results(spark, tmp_path):
    path = put(tmp_path / "m.jsonl", '{"inputs_pretokenized": "q", "choices_pretokenized": ["a", "b"]}\n')
    row = R.multiple_choice_files(spark, path).first()
    assert (row["idx"], row["label"]) == ("0", 0)
    put(tmp_path / "runs" / "r1" / "results.json", '{"accuracy": 0.5, "type": "validation", "epoch": 3}\n')
    put(tmp_path / "runs" / "r2" / "test_results.json", '{"accuracy": 0.9}\n')
    rows = R.run_results(spark, str(tmp_path / "runs" / "*" / "results.json"), ["accuracy"]).collect()
    assert [(r["run"], r["accuracy"], r["epoch"]) for r in rows] == [("r1", 0.5, 3)]


def test_tight_json_is_one_array(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "k long, text string")
    for name, rows in (("all", df), ("none", df.limit(0))):
        path = tmp_path / name
        W.write_results_json(rows, str(path), "k", loose=False)
        text = "".join(p.read_text() for p in sorted(path.glob("part-*")))
        assert json.loads(text) == [{"text": r["text"]} for r in rows.collect()]


def test_write_once_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "t")
    assert W.write_once(spark.range(3), path).count() == 3
    assert W.write_once(spark.range(9), path).count() == 3
    (tmp_path / "broken").mkdir()
    assert W.write_once(spark.range(4), str(tmp_path / "broken")).count() == 4


def test_shards(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("shard"))
    W.write_shards(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "shard=1")).count() == 25


def test_nested_predictions(spark):
    rows = [(0, 5, 1, 0, "a"), (1, 5, 1, 1, "b"), (2, 5, 0, 0, "c"), (3, 6, 9, 0, "d")]
    df = W.nested_predictions(spark.createDataFrame(rows, "pos long, passage_idx int, question_idx int, answer_idx int, label string"))
    got = {json.loads(r["v"])["idx"]: json.loads(r["v"])["passage"]["questions"] for r in df.select(F.to_json(F.struct("*")).alias("v")).collect()}
    assert got[5] == [{"idx": 1, "answers": [{"idx": 0, "label": "a"}, {"idx": 1, "label": "b"}]}, {"idx": 0, "answers": [{"idx": 0, "label": "c"}]}]


def test_nested_predictions_shuffle_once(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.choice([None, 4, 5, 6]), rng.choice([None, 0, 1, 2]), rng.choice([None, "a", "b"])) for k in range(200)]
    rng.shuffle(rows)
    df = W.nested_predictions(spark.createDataFrame(rows, "pos long, passage_idx int, question_idx int, answer_idx int, label string").repartition(5))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for _, passage, question, answer, label in sorted(rows):
        want.setdefault(passage, {}).setdefault(question, []).append((answer, label))
    assert {r["idx"]: {q["idx"]: [tuple(a) for a in q["answers"]] for q in r["passage"]["questions"]} for r in df.collect()} == want
    assert {r["idx"]: [q["idx"] for q in r["passage"]["questions"]] for r in df.collect()} == {p: list(qs) for p, qs in want.items()}
    flat = spark.createDataFrame(rows, "pos long, passage_idx int, question_idx int, answer_idx int, label string").fillna(-1, ["question_idx", "answer_idx"]).fillna("", ["label"])
    for r in W.nested_predictions(flat, order=("question_idx", "answer_idx")).collect():
        none = lambda x, y: y if x is None else x
        assert [(q["idx"], [tuple(a) for a in q["answers"]]) for q in r["passage"]["questions"]] == sorted(
            (none(q, -1), sorted((none(a, -1), none(label, "")) for a, label in found)) for q, found in want[r["idx"]].items())


def test_best_answers(spark):
    df = spark.createDataFrame([(1, 0, "N / A"), (1, 1, ""), (1, 2, "x"), (1, 3, "y"), (2, 0, "n/a")], "q int, w int, prediction string")
    assert {r["q"]: r["prediction"] for r in W.best_answers(df, "q", "w").collect()} == {1: "x", 2: ""}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    put(source / "a.json", '{"doc_id": 1, "text": "x"}\n{"doc_id": 2, "text": ""}\n')
    for name, want in (("b", {1, 3}), ("c", {1, 3, 4})):
        put(source / f"{name}.json", '{"doc_id": %d, "text": "y"}\n' % max(want))
        query = ingest_corpus(spark, str(source), "doc_id LONG, text STRING", "stories", target, checkpoint=checkpoint)
        query.awaitTermination()
        rows = [r["doc_id"] for r in spark.read.parquet(target).collect()]
        assert sorted(rows) == sorted(want)


def test_question_files_collect_behind_the_shuffle(spark, tmp_path):
    texts = ["a \"b\"\nc \\ d", "", "é]}{[,", "x" * 50]
    rows = [(k, [([(texts[k % 4], [(f"{k}-0", texts[(k + 1) % 4], [("w", 3)]), (f"{k}-1", None, [])])],)]) for k in range(0, 450)] + [(-1, [([],)])]
    kind = "doc_id long, data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
    articles = spark.createDataFrame(rows, kind)
    files = _qa_files(articles)
    plan = files._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [i for i, line in enumerate(plan) if "Exchange" in line]
    assert len(at) == 1 and all(i < at[0] for i, line in enumerate(plan) if "HashAggregate" in line)
    files.write.option("maxRecordsPerFile", 1).text(f"{tmp_path}/qa")
    back = R.nested_qa(spark, f"{tmp_path}/qa")
    assert sorted(r["n"] for r in back.select(F.size("data").alias("n")).collect()) == [1, 50, 200, 200]
    plain = lambda df: sorted((str(r) for r in df.select(F.explode("data").alias("d")).collect()))
    assert plain(back) == plain(articles)
