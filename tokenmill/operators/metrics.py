"""Scores of predictions against references.

Bag overlaps are counted within rows where keys are unique, else by (key, n-gram), so that no key's rows have to meet in one; sums and
averages combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions.text import normalize_answer, split_words
from tokenmill.operators.prefix import position
from tokenmill.session import cut_lineage

NOT_ANSWERABLE = "N/A"
SMOOTHING = 1e-5  # fixed value of the smoothed token F1
LOG_OF_ZERO = -9999999999.0  # fixed value: what BLEU takes for log(0)
LOSS_CAP = 20.0  # fixed value: largest loss that perplexity is computed from
PADDED_CHOICE = -10000.0  # fixed value: score of a choice that only pads


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


# --- labels ----------------------------------------------------------------------------------------------------------


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Share of equal labels in percent; 0 for no rows."""
    return df.agg(F.coalesce(F.avg((F.col(prediction) == F.col(label)).cast("double")) * 100.0, F.lit(0.0)).alias("accuracy"))


def f1_binary(df: DataFrame, prediction: str = "prediction", label: str = "label", positive=1) -> DataFrame:
    predicted, actual = F.col(prediction) == positive, F.col(label) == positive
    both = F.sum((predicted & actual).cast("int"))
    either = F.sum(predicted.cast("int")) + F.sum(actual.cast("int"))
    return df.agg(_ratio(2.0 * both, either).alias("f1"))


def f1_macro(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Mean F1 over the classes seen in labels or predictions."""
    hit = (F.col(prediction) == F.col(label)).cast("int")
    sides = F.array(F.struct(F.col(prediction).alias("c"), hit.alias("hit")), F.struct(F.col(label).alias("c"), F.lit(0).alias("hit")))
    per_class = df.select(F.explode(sides).alias("s")).groupBy("s.c").agg(F.sum("s.hit").alias("hits"), F.count("*").alias("seen"))
    return per_class.agg(F.avg(2.0 * F.col("hits") / F.col("seen")).alias("f1_macro"))


def combined_scores(scores: DataFrame, metric: str = "metric", value: str = "value", count: str = "n") -> DataFrame:
    """One score per metric over several datasets, weighted by their sizes."""
    return scores.groupBy(metric).agg((F.sum(F.col(value) * F.col(count)) / F.sum(count)).alias(value))


# --- texts -----------------------------------------------------------------------------------------------------------


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return words
    return A.let(words, lambda w: F.transform(A.counting(0, F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i + 1, n), " ")))


def _numbered(words: Column) -> Column:
    """Words in order, each repeat with its number behind a line end: a bag as a set. Words with a line end may stand for another's repeat."""
    def each(w: Column) -> Column:
        starts = F.filter(A.indices(w), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return A.let(starts, lambda ss: F.flatten(F.transform(ss, lambda s, k: A.let(F.get(w, s), lambda own: F.transform(
            A.counting(0, F.coalesce(F.get(ss, k + 1), F.size(w)) - s), lambda i: F.when(i == 0, own).otherwise(F.concat(own, F.lit("\n"), i.cast("string"))))))))

    # Most texts repeat few words; one without repeats is its own set.
    return A.let(F.sort_array(words), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), w).otherwise(each(w)))


def bag_overlap(df: DataFrame, keys: Sequence[str], left: Column, right: Column, keyed: DataFrame | None = None) -> DataFrame:
    """Clipped matches of two token bags (tokens without line ends), and both sizes, per key; empty bags count as size 0.

    Where no key has two rows, each row is counted where it lies; else the bags of a key's rows are put together. `keyed` are the keys of
    the same rows, where they are had for less.
    """
    if (df if keyed is None else keyed).groupBy(*keys).count().filter("count > 1").isEmpty():
        bags = df.select(*keys, left.alias("__l"), right.alias("__r")).filter("__l is not null and __r is not null")
        matched = F.size(F.array_intersect(_numbered(F.col("__l")), _numbered(F.col("__r"))))
        return bags.select(*keys, *[n.cast("bigint").alias(c) for c, n in (("matched", matched), ("n_left", F.size("__l")), ("n_right", F.size("__r")))])
    side = lambda array, a, b: F.transform(array, lambda g: F.struct(g.alias("g"), F.lit(a).alias("a"), F.lit(b).alias("b")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("a"), F.lit(0).alias("b")))
    grams = df.select(*keys, F.explode(F.concat(side(left, 1, 0), side(right, 0, 1), none)).alias("x"))
    counted = grams.groupBy(*keys, "x.g").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    return counted.groupBy(*keys).agg(
        F.sum(F.least("a", "b")).alias("matched"), F.sum("a").alias("n_left"), F.sum("b").alias("n_right"))


def f1_of_overlap(matched: Column, n_left: Column, n_right: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without a match."""
    return F.when(matched == 0, F.lit(0.0)).otherwise(2.0 * matched / (n_left + n_right))


def exact_match(prediction: Column, truth: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(truth)).cast("double")


def answer_words(text: Column) -> Column:
    """Words of a normalized answer."""
    return split_words(normalize_answer(text))


def token_f1(df: DataFrame, keys: Sequence[str], prediction: str, truth: str, words: Callable[[Column], Column] = answer_words, keyed: DataFrame | None = None) -> DataFrame:
    """Token F1 of normalized answers per key. A caller whose columns hold `answer_words` already, once for a text of several rows, gives the identity as `words`."""
    bags = bag_overlap(df, keys, words(F.col(prediction)), words(F.col(truth)), keyed)
    return bags.select(*keys, f1_of_overlap(F.col("matched"), F.col("n_left"), F.col("n_right")).alias("f1"))


def smoothed_f1(df: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """Token F1 of lower-cased words with a smoothed denominator; two empty texts agree fully."""
    bags = bag_overlap(df, keys, split_words(F.lower(left)), split_words(F.lower(right)))
    p, r = F.col("matched") / F.col("n_left"), F.col("matched") / F.col("n_right")
    empty = (F.col("n_left") == 0) | (F.col("n_right") == 0)
    score = F.when(empty, (F.col("n_left") == F.col("n_right")).cast("double")).otherwise(2.0 * p * r / (p + r + SMOOTHING))
    return bags.select(*keys, score.alias("f1"))


def best_over_truths(scored: DataFrame, questions: DataFrame, key: str, score: str) -> DataFrame:
    """Mean in percent of the best score over a question's truths; questions without truths count as 0."""
    best = scored.groupBy(key).agg(F.max(score).alias("best"))
    return questions.select(key).join(best, key, "left").agg((F.avg(F.coalesce("best", F.lit(0.0))) * 100.0).alias(score))


def first_answered(windows: DataFrame, key: str, order: str, prediction: str) -> DataFrame:
    """Per question the first prediction over its windows that is an answer, else the not-answerable mark."""
    blank = F.lower(F.replace(F.col(prediction), F.lit(" "), F.lit(""))) == "n/a"
    first = F.min_by(F.when(~blank, F.col(prediction)), F.when(~blank, F.col(order)))
    return windows.groupBy(key).agg(F.coalesce(first, F.lit(NOT_ANSWERABLE)).alias(prediction))


def answers_with_windows(windows: DataFrame, truths: DataFrame, key: str, order: str) -> DataFrame:
    """Exact match and token F1 over questions asked on several windows.

    `windows` has (key, order, prediction), `truths` has (key, answer) with the not-answerable mark as the only answer of an
    unanswerable question, which is scored by equality.
    """
    predicted = first_answered(windows, key, order, "prediction")
    rows = predicted.join(truths, key, "left")
    unanswerable = F.col("answer") == NOT_ANSWERABLE
    rows = rows.withColumn("em", F.when(unanswerable, (F.col("prediction") == NOT_ANSWERABLE).cast("double")).otherwise(exact_match(F.col("prediction"), F.col("answer"))))
    overlap = token_f1(rows.select(key, "answer", "prediction"), [key, "answer"], "prediction", "answer")
    rows = rows.join(overlap, [key, "answer"], "left")
    rows = rows.withColumn("f1", F.when(unanswerable, F.col("em")).otherwise(F.col("f1")))
    best = rows.groupBy(key).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    mean = lambda c: (F.avg(F.coalesce(c, F.lit(0.0))) * 100.0).alias(c)
    return best.agg(mean("em"), mean("f1"))


def all_answers_right(df: DataFrame, question: str, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Share of questions whose answer labels are all right; questions are told apart by their id only."""
    per_question = df.groupBy(question).agg(F.bool_and(F.col(prediction) == F.col(label)).alias("right"))
    return per_question.agg(F.avg(F.col("right").cast("double")).alias("em"))


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits. (A stemmer is left to the caller.)"""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def rouge_n(df: DataFrame, keys: Sequence[str], prediction: str, reference: str, n: int) -> DataFrame:
    """N-gram F1 per key."""
    bags = bag_overlap(df, keys, ngrams(rouge_tokens(F.col(prediction)), n), ngrams(rouge_tokens(F.col(reference)), n))
    return bags.select(*keys, f1_of_overlap(F.col("matched"), F.col("n_left"), F.col("n_right")).alias("rouge"))


def lcs_positions(a: Sequence[str], b: Sequence[str]) -> list[int]:
    """Positions in `a` of one longest common subsequence with `b`, walking back from the ends, shortening `a` on a tie.

    A row of the table of lengths is one whole number with a bit for each place of `b`, zero where the length grows. Only every
    k-th row is kept, k about the root of the number of rows; the rows between two kept ones are made again for the walk back.
    """
    places: dict[str, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1

    def below(row: int, x: str) -> int:
        met = row & places.get(x, 0)
        return (row + met | row - met) & full

    step, row, kept = isqrt(len(a)) + 1, full, [full]
    for i, x in enumerate(a, 1):
        row = below(row, x)
        if i % step == 0:
            kept.append(row)
    length = lambda row, j: j - (row & (1 << j) - 1).bit_count()
    i, j, first, rows, found = len(a), len(b), len(a) + 1, [], []
    while i and j:
        if i - 1 < first:
            first = (i - 1) // step * step
            rows = list(accumulate(a[first:first + step], below, initial=kept[first // step]))
        if a[i - 1] == b[j - 1]:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif length(rows[i - first], j - 1) > length(rows[i - first - 1], j):
            j -= 1
        else:
            i -= 1
    return found[::-1]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The positions of `a` that are common with `b`, for a batch of sentence pairs."""
    for batch in batches:
        pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())
        found = [[{"at": i, "token": a[i]} for i in lcs_positions(a, b)] for a, b in pairs]
        column = pa.array(found, pa.list_(pa.struct([("at", pa.int64()), ("token", pa.string())])))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c not in ("a", "b")), column], [*(c for c in batch.schema.names if c not in ("a", "b")), "met"])


def rouge_l(df: DataFrame, keys: Sequence[str], prediction: Column, reference: Column) -> DataFrame:
    """Summary-level longest-common-subsequence F1 per key (unique) over arrays of sentences.

    Every pair of sentences is a row. A predicted sentence's common tokens are the union over the reference's sentences; a
    token counts at most as often as the reference has it.
    """
    clean = lambda array: F.filter(F.transform(array, rouge_tokens), lambda s: F.size(s) > 0)
    sides = df.select(*keys, clean(prediction).alias("p"), clean(reference).alias("r"))
    none, zero = F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint")
    sizes = sides.select(*keys, none, zero.alias("met"), zero.alias("held"), F.size(F.flatten("p")).cast("bigint").alias("n_p"), F.size(F.flatten("r")).cast("bigint").alias("n_r"))
    held = sides.select(*keys, F.explode(F.flatten("r")).alias("token")).select("*", zero.alias("met"), F.lit(1).cast("bigint").alias("held"), zero.alias("n_p"), zero.alias("n_r"))
    pairs = sides.select(*keys, F.posexplode("p").alias("__i", "a"), "r").select(*keys, "__i", "a", F.explode("r").alias("b"))
    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    common = pairs.mapInArrow(_common, f"{head}, __i int, met array<struct<at:bigint,token:string>>")
    common = common.select(*keys, "__i", F.explode("met").alias("m")).select(*keys, "__i", "m.at", "m.token").distinct()
    met = common.select(*keys, "token", F.lit(1).cast("bigint").alias("met"), zero.alias("held"), zero.alias("n_p"), zero.alias("n_r"))
    totals = ("met", "held", "n_p", "n_r")
    tokens = sizes.unionByName(held).unionByName(met).groupBy(*keys, "token").agg(*[F.sum(c).alias(c) for c in totals])
    found = tokens.groupBy(*keys).agg(F.sum(F.least("met", "held")).alias("hits"), F.sum("n_p").alias("n_p"), F.sum("n_r").alias("n_r"))
    return found.select(*keys, f1_of_overlap(F.col("hits"), F.col("n_p"), F.col("n_r")).alias("rouge"))


def corpus_bleu(df: DataFrame, key: str, hypothesis: Column, references: Column, lower: bool = False) -> DataFrame:
    """Corpus BLEU-4 in percent: clipped n-gram precision against any reference, brevity against the closest length."""
    form = F.lower if lower else (lambda c: c)
    df = df.select(key, split_words(form(hypothesis)).alias("h"), F.transform(references, lambda r: split_words(form(r))).alias("rs"))

    def grams(words: Column, number: Column) -> Column:
        def of_size(n: int) -> Column:
            return F.transform(ngrams(words, n), lambda g: F.struct(number.alias("ref"), F.lit(n).alias("n"), g.alias("g")))

        return F.concat(*[of_size(n) for n in range(1, 5)])

    rows = F.concat(grams(F.col("h"), F.lit(-1)), F.flatten(F.transform("rs", lambda r, i: grams(r, i))))
    counted = df.select(key, F.explode(rows).alias("x")).groupBy(key, "x.n", "x.g", "x.ref").agg(F.count("*").alias("c"))
    clipped = counted.groupBy(key, "n", "g").agg(
        F.coalesce(F.max(F.when(F.col("ref") == -1, F.col("c"))), F.lit(0)).alias("h"),
        F.coalesce(F.max(F.when(F.col("ref") >= 0, F.col("c"))), F.lit(0)).alias("r"))
    by_n = clipped.groupBy("n").agg(F.sum(F.least("h", "r")).alias("correct"), F.sum("h").alias("total"))
    precision = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0)
    by_n = by_n.agg(*[F.coalesce(F.max(F.when(F.col("n") == n, precision)), F.lit(0.0)).alias(f"p{n}") for n in range(1, 5)])
    # Closest reference length; the shorter one on a tie.
    closest = F.array_min(F.transform("rs", lambda r: F.struct(F.abs(F.size(r) - F.size("h")).alias("d"), F.size(r).alias("len"))))["len"]
    lengths = df.agg(F.sum(F.size("h")).cast("bigint").alias("hyp_len"), F.sum(closest).cast("bigint").alias("ref_len"))
    log = lambda c: F.when(F.col(c) > 0, F.log(c)).otherwise(F.lit(LOG_OF_ZERO))
    brevity = F.when(F.col("hyp_len") < F.col("ref_len"), F.exp(1.0 - F.col("ref_len") / F.col("hyp_len"))).otherwise(1.0)
    bleu = 100.0 * brevity * F.exp((log("p1") + log("p2") + log("p3") + log("p4")) / 4.0)
    bleu = F.when(F.col("ref_len") == 0, F.lit(0.0)).otherwise(bleu)
    # Both sides are one row.
    return by_n.crossJoin(F.broadcast(lengths)).select(bleu.alias("bleu"), "p1", "p2", "p3", "p4", "hyp_len", "ref_len")


# --- losses and scores -----------------------------------------------------------------------------------------------


def perplexity(losses: DataFrame, n_tokens: Column, n_original: Column, loss: str = "loss", mask: str = "mask") -> DataFrame:
    """Mean loss, perplexity, and perplexity per original token; `n_tokens` and `n_original` are aggregates."""
    sums = losses.agg(F.sum(F.col(loss) * F.col(mask)).alias("s"), n_tokens.alias("t"), n_original.alias("o"))
    mean, ratio = F.col("s") / (F.col("t") - 1), (F.col("t") - 1) / (F.col("o") - 1)
    capped = lambda x: F.exp(F.least(F.lit(LOSS_CAP), x))
    return sums.select(mean.alias("avg_loss"), capped(mean).alias("ppl"), capped(mean * ratio).alias("adjusted_ppl"), ratio.alias("token_ratio"))


def cloze_accuracy(tokens: DataFrame, key: str, correct: str = "correct", mask: str = "mask") -> DataFrame:
    """Share of examples, in percent, whose scored tokens are all right."""
    per_example = tokens.groupBy(key).agg(F.bool_and((F.col(mask) == 0) | F.col(correct)).alias("right"))
    return per_example.agg((F.avg(F.col("right").cast("double")) * 100.0).alias("accuracy"))


def choice_scores(tokens: DataFrame, keys: Sequence[str], choice: str = "choice", score: str = "score", mask: str = "mask", length_penalty: float = 0.0) -> DataFrame:
    """Score of a choice: the sum of its scored tokens (over all segments), divided by a power of their number if wanted."""
    total = F.sum(F.col(score) * F.col(mask))
    if length_penalty > 0:
        total = total / F.pow(F.sum(mask).cast("double"), F.lit(length_penalty))
    return tokens.groupBy(*keys, choice).agg(total.alias(score))


def best_choice(scores: DataFrame, keys: Sequence[str], choice: str = "choice", score: str = "score", valid: Column | None = None) -> DataFrame:
    """The highest-scoring choice per key, the first one on a tie; choices that only pad score far below."""
    value = F.col(score) if valid is None else F.when(valid, F.col(score)).otherwise(F.lit(PADDED_CHOICE))
    return scores.groupBy(*keys).agg(F.max_by(choice, F.struct(value, -F.col(choice))).alias("prediction"))


def inverted(prediction: Column) -> Column:
    """1 where the first choice won, else 0."""
    return F.when(prediction == 0, 1).otherwise(0)


OBJECTIVES = {"gpt": "generation", "bert": "token", "sentence": "sentence", "multi-task": "multi_task"}


def objective_losses(log: DataFrame, mode: str = "mode", loss: str = "loss") -> DataFrame:
    """Mean loss over all batches and per objective (0 where none occurred), and the perplexity of the overall mean."""
    columns = [F.avg(loss).alias("total")]
    columns += [F.coalesce(F.avg(F.when(F.col(mode) == value, F.col(loss))), F.lit(0.0)).alias(name) for value, name in OBJECTIVES.items()]
    return log.agg(*columns).withColumn("ppl", F.exp(F.least(F.lit(LOSS_CAP), F.col("total"))))


def log_intervals(log: DataFrame, interval: int, iteration: str = "iteration", loss: str = "loss", elapsed: str = "elapsed_ms") -> DataFrame:
    """Mean loss and time per iteration over each run of `interval` iterations."""
    step = F.floor((F.col(iteration) - 1) / interval)
    return log.groupBy(((step + 1) * interval).alias("iteration")).agg(F.avg(loss).alias("avg_loss"), F.avg(elapsed).alias("avg_ms"))


def best_evaluation(evaluations: DataFrame, keys: Sequence[str], metric: str, epoch: str = "epoch") -> DataFrame:
    """The evaluation that first reached the highest value."""
    top = F.max_by(F.struct(epoch, metric), F.struct(F.col(metric), -F.col(epoch)))
    return evaluations.groupBy(*keys).agg(top.alias("best")).select(*keys, "best.*")


def group_medians(values: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """(group, median): the mean of the one or two middle values, by ranks of a sort over all partitions. Nulls don't count.

    No buffer grows with a group: besides the sort there is one row for each group and range.
    """
    known = values.filter(F.col(value).isNotNull()).select(group, value, tie)
    ranked = cut_lineage(position(known, [value, tie], "__rank", within=[group]))
    sizes = known.groupBy(group).agg(F.count("*").alias("__n"))
    middle = ranked.join(sizes, group).filter((F.col("__rank") == F.floor((F.col("__n") - 1) / 2)) | (F.col("__rank") == F.floor(F.col("__n") / 2)))
    return middle.groupBy(group).agg(F.avg(value).alias("median"))


def run_summary(results: DataFrame, metrics: Sequence[str], run: str, target: str) -> DataFrame:
    """Best run by `target`, and mean and median of every metric over all runs."""
    stacked = results.select(run, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x"), F.col(target).alias("__target"))
    stacked = stacked.select(run, "x.*", "__target")
    summed = stacked.groupBy("metric").agg(F.avg("value").alias("mean"), F.max_by("value", F.struct(F.col("__target"), F.col(run))).alias("at_best_run"))
    # Both sides have a row for each metric.
    return summed.join(group_medians(stacked, "metric", "value", run), "metric", "left").select("metric", "mean", "median", "at_best_run")


def _truth_rows(df: DataFrame) -> DataFrame:
    return df.select("question", "prediction", F.posexplode("truths").alias("truth_no", "truth"))


def truths_matched(df: DataFrame) -> DataFrame:
    """Exact match with the best of a question's truths, in percent."""
    scored = _truth_rows(df).select("question", exact_match(F.col("prediction"), F.col("truth")).alias("em"))
    return best_over_truths(scored, df, "question", "em")


def truths_f1(df: DataFrame) -> DataFrame:
    """Token F1 with the best of a question's truths, in percent."""
    return best_over_truths(token_f1(_truth_rows(df), ["question", "truth_no"], "prediction", "truth"), df, "question", "f1")


# Metrics by name. A metric takes joined predictions and gives one value: label metrics read (prediction, label), those over
# questions (question) too, and text metrics one row per question with (question, prediction, truths).
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "accuracy": accuracy, "f1": f1_binary, "f1-macro": f1_macro, "f1a": f1_binary, "acc": accuracy,
    "em": lambda df: all_answers_right(df, "question"), "EM": truths_matched, "F1": truths_f1,
}
# The metrics of every task.
TASK_METRICS: dict[str, tuple[str, ...]] = {
    "copa": ("accuracy",),
    "rte": ("accuracy",),
    "boolq": ("accuracy",),
    "wic": ("accuracy",),
    "wsc": ("accuracy",),
    "cb": ("accuracy", "f1-macro"),
    "record": ("EM", "F1"),
    "multirc": ("f1a", "em", "acc"),
    "mnli": ("accuracy",),
    "sst2": ("accuracy",),
    "qnli": ("accuracy",),
    "qqp": ("accuracy",),
    "mrpc": ("accuracy",),
    "cola": ("accuracy",),
    "squad": ("accuracy",),
    "afqmc": ("accuracy",),
    "tnews": ("accuracy",),
    "cluewsc": ("accuracy",),
    "cmrc": ("accuracy",),
    "multichoice": ("accuracy",),
}


def evaluate(predictions: DataFrame, task: str) -> DataFrame:
    """(task, metric_no, metric, value): every metric of the task over its joined predictions."""
    rows = []
    for number, name in enumerate(TASK_METRICS[task]):
        score = METRICS[name](predictions)
        rows.append(score.select(F.lit(task).alias("task"), F.lit(number).alias("metric_no"), F.lit(name).alias("metric"), F.col(score.columns[0]).cast("double").alias("value")))
    return reduce(DataFrame.unionByName, rows)


def task_metrics(examples: DataFrame, task: str = "task") -> DataFrame:
    """Examples under every metric of their task, in the task's order."""
    sets = F.create_map(*[x for name, metrics in TASK_METRICS.items() for x in (F.lit(name), F.array(*map(F.lit, metrics)))])
    return examples.select("*", F.posexplode(sets[F.col(task)]).alias("metric_no", "metric"))

