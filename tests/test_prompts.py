"""Truncation, slots and layouts of prompts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import examples as E
from tokenmill.operators import layout as L
from tokenmill.operators import prompts as P
from tokenmill.operators.examples import TASKS
from tokenmill.operators.special import special_tokens

SP = special_tokens(1000)


def shorten(parts, removed):
    """One token at a time, as the pattern encoder does it."""
    parts = [(side, list(tokens), short) for side, tokens, short in parts]
    free = lambda side: sum(len(t) for s, t, short in parts if short and s == side)
    for _ in range(removed):
        side = "a" if free("a") > free("b") else "b"
        candidates = [i for i, (s, t, short) in enumerate(parts) if s == side and short and t]
        if not candidates:
            return None
        parts[candidates[-1]][1].pop()
    return parts


def test_truncation_one_by_one(spark):
    rows = []
    for a1 in range(0, 5):
        for a2 in range(0, 4):
            for b1 in range(0, 6):
                for limit in (4, 7, 11):
                    parts = [("a", [1] * a1, True), ("a", [2, 2], False), ("a", [3] * a2, True), ("b", [4] * b1, True)]
                    rows.append((parts, limit))
    for limit in (4, 7, 11):
        mine = [(i, parts) for i, (parts, n) in enumerate(rows) if n == limit]
        df = spark.createDataFrame(mine, "k int, parts array<struct<side:string,tokens:array<int>,shortenable:boolean>>")
        for r in P.truncate_parts(df, "parts", F.lit(0), limit).collect():
            given = dict(mine)[r["k"]]
            removed = max(sum(len(t) for _, t, _ in given) + 3 - limit, 0)
            want = shorten(given, removed)
            assert r["removed"] == removed and r["overflow"] == (want is None)
            if want is not None:
                assert [(p["side"], p["tokens"], p["shortenable"]) for p in r["parts"]] == want


@pytest.mark.parametrize(("learned", "sizes"), [(0, [0, 0, 0]), (10, [4, 4, 2]), (3, [1, 1, 1]), (4, [2, 2, 0])])
def test_slot_sizes(learned, sizes):
    assert P._slot_sizes(P.parts_of("~x~y~z"), learned) == sizes


def test_every_task_has_patterns_and_words():
    for task, spec in TASKS.items():
        prompt = P.PROMPTS[P.PROMPT_ALIASES.get(task, task)]
        for i, template in prompt.patterns.items():
            assert sum(1 for part in P.parts_of(template) if part[1] == "mask") == 1
            assert prompt.answers is not None or set(prompt.words[i]) == set(spec.labels), task


def test_race_uses_the_blank_when_there_is_one(spark):
    df = spark.createDataFrame([(1, "ctx", "Who _ it?", ["a"]), (2, "ctx", "Who did?", ["a"])], "guid int, text_a string, text_b string, choices array<string>")
    df = df.withColumn("meta", F.struct("choices"))
    rows = {(r["guid"], r["pattern_id"]): r["b"] for r in P.render(df, "race").select("guid", "pattern_id", P.side_text(F.col("parts"), "b").alias("b")).collect()}
    assert rows[1, 0] == " Who[MASK] it?" and rows[2, 0] == " Question: Who did? Answer:[MASK]"
    assert rows[2, 1] == " Based on the previous passage, Who did?[MASK]"


def test_input_layout(spark):
    df = spark.createDataFrame([([1, SP.mask, 2], [3], [8, 9, SP.eop])], "tokens_a array<int>, tokens_b array<int>, answer array<int>")
    r = L.build_input(df, SP, 12, answer="answer", add_sep=True).first()
    assert r["ids"] == [SP.cls, 1, SP.mask, 2, SP.sep, 3, SP.eos, SP.sop, 8, 9, SP.eos, SP.eos]
    assert r["types"] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, SP.eos, SP.eos]
    assert r["position"] == [0, 1, 2, 3, 4, 5, 6, 2, 2, 2, 0, 0]
    assert r["block_position"] == [0] * 7 + [1, 2, 3, 0, 0]
    assert r["target"] == [0] * 7 + [8, 9, SP.eop, 0, 0] and r["logit_mask"] == [0] * 7 + [1, 1, 1, 0, 0]
    assert r["sep"] == 7


def test_input_layout_cap(spark):
    df = spark.createDataFrame([([SP.mask, *range(20)],)], "tokens_a array<int>")
    r = L.build_input(df, SP, 10, b=None).first()
    assert r["ids"] == [SP.cls, SP.mask, *range(7), SP.eos] and r["sep"] == 10


def test_single_token_words(spark):
    vocab = spark.createDataFrame([("Yes", False), ("No", True)], "token string, is_command boolean")
    rows = P.single_token_violations(P.verbalizer_table(spark, "mrpc"), vocab).collect()
    assert {r["answer"] for r in rows} == {" No"}


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Hi", "[CLS]Hi [gMASK]"), ("Hi [MASK].", "[CLS]Hi [MASK].<|endoftext|>"), ("Hi [gMASK]", "[CLS]Hi [gMASK]")],
)
def test_interactive_context(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(P.interactive_context(F.col("t")).alias("o")).first()["o"] == expected


def test_question_generation_takes_the_last_start(spark):
    kind = "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"
    rng = random.Random(4)
    many = [(rng.choice(["x", "y", "zz", "", None]), i) for i in range(300)]
    qas = [("a", "who", many), ("b", "what", []), ("c", "where", [("x", 5), ("y", 1), ("x", 2)]), ("d", "why", None)]
    df = E.question_generation(spark.createDataFrame([([([("text", qas), ("none", [])],)],), ([],), (None,)], kind), "train")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1
    want = [("train-" + q + (f"-{t}" if t is not None else ""), question, t, s, q) for q, question, answers in qas for t, s in dict(answers or []).items()]
    assert Counter((r["guid"], r["meta"]["question"], r["meta"]["answer"], r["meta"]["answer_start"], r["idx"]) for r in df.collect()) == Counter(want)


def test_answer_sentences_makes_its_rows_once(spark):
    kind = "idx long, passage struct<text:string,questions:array<struct<idx:int,question:string,answers:array<struct<idx:int,text:string,label:int>>>>>"
    rows = [(1, ("“t”", [(0, "q – ’1’", [(0, "“a”", 1), (None, "b", 0)]), (1, "none", [])])), (None, ("u", [(3, "q‘", [(7, None, 1)])])), (2, ("v", []))]
    df = E.answer_sentences(spark.createDataFrame(rows, kind), "dev")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    got = sorted((r["guid"], r["text_a"], r["text_b"], r["meta"]["answer"], r["label"]) for r in df.collect())
    assert got == [("dev-p1-q0-a0", '"t"', "q - '1'", '"a"', "1"), ("dev-p1-q0-anull", '"t"', "q - '1'", "b", "0"), ("dev-pnull-q3-a7", "u", "q'", None, "1")]


def test_marked_spans(spark):
    rows = [(text, a, b, n, k) for text in ("", "x", "aé𝄞d", "abcdef") for a in (-1, 0, 2, 5, None) for b in (0, 1, 3, 9) for n in (0, 1, 2) for k in (1, 3)]
    meta = "meta struct<span1_index:int,span2_index:int,span1_length:int,span2_length:int>"
    df = spark.createDataFrame([(t, (a, b, n, k)) for t, a, b, n, k in rows], f"text_a string, {meta}").select("*", P._spans_marked().alias("got"))
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no array of all characters
    for r in df.collect():
        (s1, s2, n1, n2), want = r["meta"], ""
        for i, c in enumerate(r["text_a"]):
            opened = "#" * (i == s1) + "*" * (i == s2)
            want += opened + c + "*" * (i == s2 + n2 - 1) + "#" * (s1 is not None and i == s1 + n1 - 1)
        assert r["got"] == want, r


def test_answers_of_a_long_question_are_rows_one_by_one(spark):
    words = " ".join(f"{k:011d}" for k in range(14_000))  # beside each of its answers the question takes 2.3 GB
    raw = spark.createDataFrame([(1, words)], "idx long, line string").withColumn("answers", F.transform(F.split("line", " "), lambda w, i: F.struct(i.alias("idx"), w.alias("text"), F.lit(1).alias("label"))))
    question = F.struct(F.lit(0).alias("idx"), F.col("line").alias("question"), F.col("answers"))
    none = F.struct(F.lit(1).alias("idx"), F.lit("none").alias("question"), F.slice("answers", 1, 0).alias("answers"))
    examples = E.answer_sentences_text(E.answer_sentences(raw.select("idx", F.struct(F.lit("text").alias("text"), F.array(question, none).alias("questions")).alias("passage")), "dev"))
    got = examples.agg(F.count("*"), F.min(F.length("text_b")), F.max(F.length("text_b")), F.count_distinct("guid"), F.max_by("idx", F.col("meta.answer"))).first()
    assert tuple(got) == (14_000, len(words) + 20, len(words) + 20, 14_000, "1,0,13999")
