"""Metrics on hand cases and against step-by-step models."""

import random
import statistics
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import metrics as M


def one(df):
    return df.first()[0]


def test_accuracy_of_nothing(spark):
    assert one(M.accuracy(spark.createDataFrame([], "prediction int, label int"))) == 0.0


def test_f1(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (2, 2)], "prediction int, label int")
    assert one(M.f1_binary(df)) == pytest.approx(0.5)
    assert one(M.f1_macro(df)) == pytest.approx((0 + 0.5 + 1) / 3)


def test_token_f1_edge_cases(spark):
    df = spark.createDataFrame([(1, "the cat", "a cat!"), (2, "dog", "cat"), (3, "", ""), (4, "Of x", "of y")], "k int, p string, t string")
    assert {r["k"]: r["f1"] for r in M.token_f1(df, ["k"], "p", "t").collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.5}
    assert {r["k"]: round(r["f1"], 3) for r in M.smoothed_f1(df, ["k"], "p", "t").collect()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.5}


def test_questions_without_truths_count(spark):
    scored = spark.createDataFrame([(1, 0.5), (1, 1.0)], "q int, s double")
    assert one(M.best_over_truths(scored, spark.createDataFrame([(1,), (2,)], "q int"), "q", "s")) == 50.0


def test_answers_with_windows(spark):
    windows = spark.createDataFrame([(1, 0, "N / A"), (1, 1, "Paris"), (1, 2, "Rome"), (2, 0, "n/a"), (3, 0, "x")], "q int, w int, prediction string")
    truths = spark.createDataFrame([(1, "the paris"), (1, "London"), (2, "N/A"), (3, "N/A")], "q int, answer string")
    row = M.answers_with_windows(windows, truths, "q", "w").first()
    assert row["em"] == pytest.approx(200 / 3) and row["f1"] == pytest.approx(200 / 3)


def test_bleu_tie_takes_shorter_reference(spark):
    df = spark.createDataFrame([(1, "a b c d e", ["a b c d", "a b c d e f"])], "k int, h string, r array<string>")
    row = M.corpus_bleu(df, "k", F.col("h"), F.col("r")).first()
    assert (row["hyp_len"], row["ref_len"], row["bleu"]) == (5, 4, pytest.approx(100.0))


def test_bleu_without_matches(spark):
    row = M.corpus_bleu(spark.createDataFrame([(1, "x", ["a b"])], "k int, h string, r array<string>"), "k", F.col("h"), F.col("r")).first()
    assert row["bleu"] == 0.0


def lcs_positions(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def test_rouge_l(spark):
    rng = random.Random(1)
    text = lambda: [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 4))]
    rows = [(i, text(), text()) for i in range(80)] + [(99, [], ["a"])]
    df = M.rouge_l(spark.createDataFrame(rows, "k int, p array<string>, r array<string>"), ["k"], F.col("p"), F.col("r"))
    got = {r["k"]: r["rouge"] for r in df.collect()}
    for k, p, r in rows:
        left, right = [s.split() for s in p], [s.split() for s in r]
        flat = lambda side: [w for s in side for w in s]
        budget = {w: [flat(left).count(w), flat(right).count(w)] for w in flat(left) + flat(right)}
        hits = 0
        for sentence in left:
            for position in sorted(set().union(set(), *[lcs_positions(sentence, other) for other in right])):
                counts = budget[sentence[position]]
                if min(counts) > 0:
                    counts[0], counts[1], hits = counts[0] - 1, counts[1] - 1, hits + 1
        want = 2 * hits / (len(flat(left)) + len(flat(right))) if hits else 0.0
        assert got[k] == pytest.approx(want), k


def test_common_subsequences_by_kept_rows():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.randrange(40))] for _ in range(2))
        assert M.lcs_positions(a, b) == sorted(lcs_positions(a, b))


def test_long_sentences_in_linear_space():
    rng = random.Random(7)
    a, b = ([str(rng.randrange(2000)) for _ in range(50_000)] for _ in range(2))
    tracemalloc.start()
    found = M.lcs_positions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rest = iter(b)
    assert peak < 100 << 20 and all(a[i] in rest for i in found) and len(found) > 1500


def test_best_choice_first_wins_and_padding_loses(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, -1.0), (2, 1, 5.0)], "k int, choice int, score double")
    rows = {r["k"]: r["prediction"] for r in M.best_choice(df, ["k"], valid=~((F.col("k") == 2) & (F.col("choice") == 1))).collect()}
    assert rows == {1: 0, 2: 0}


def test_best_evaluation_keeps_the_first_maximum(spark):
    df = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9)], "run string, epoch int, acc double")
    assert M.best_evaluation(df, ["run"], "acc").first()["epoch"] == 2


def test_medians_by_ranks(spark):
    rng = random.Random(3)
    rows = [(f"g{k % 4}", rng.choice([None, 0.5, rng.random()]), k) for k in range(403)] + [("one", 7.0, 1), ("none", None, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, run int").repartition(6)
    got = {r["g"]: r["median"] for r in M.group_medians(frame, "g", "v", "run").collect()}
    assert got == {g: statistics.median(vs) for g in {r[0] for r in rows} if (vs := [v for h, v, _ in rows if h == g and v is not None])}


def test_run_summary(spark):
    runs = spark.createDataFrame([(1, 0.5, 3.0), (2, 0.9, None), (3, 0.9, 1.0), (4, 0.1, 2.0)], "run int, acc double, f1 double")
    got = {r["metric"]: tuple(r)[1:] for r in M.run_summary(runs, ["acc", "f1"], "run", "acc").collect()}
    assert got["acc"] == (pytest.approx(0.6), pytest.approx(0.7), 0.9) and got["f1"] == (2.0, 2.0, 1.0)
    plan = M.run_summary(runs, ["acc", "f1"], "run", "acc")._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan.replace("AS median", "").replace("median#", "")


def test_bags_stay_in_their_rows(spark, monkeypatch):
    rows = [(1, "a b a c a", "a a b d"), (2, "", "x"), (3, None, "x"), (4, "b b", "b"), (5, "same same", "same same same")]
    df = spark.createDataFrame(rows, "k int, l string, r string")
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = M.bag_overlap(df, ["k"], words(F.col("l")), words(F.col("r")))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {1: (3, 5, 4), 2: (0, 0, 1), 4: (1, 2, 1), 5: (2, 2, 3)}
    twice = M.bag_overlap(df.withColumn("k", F.when(F.col("k") < 5, 1).otherwise(5)).where("l is not null"), ["k"], words(F.col("l")), words(F.col("r")))
    assert {r["k"]: tuple(r)[1:] for r in twice.collect()} == {1: (4, 7, 6), 5: (2, 2, 3)}
