"""Benchmark rows to the common example table `(guid, text_a, text_b, label, idx, num_choices, meta)`.

Every builder is row-local: nested questions and answers are exploded where they stand, so no builder shuffles. `raw` has the
fields of the task's file; `line_no` is the 0-based line (or row) number where the file has no id of its own. Passages are normalized
once, before their questions are exploded; `carry` says what each of their examples holds of the passage: all of it, or for
instance a digest by which it is joined later.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions.hashing import hash_below
from tokenmill.functions.text import clean_review, clean_spaces, highlights_as_list, split_words, standardize_punctuation

WSC_CANDIDATES = 9  # candidates per training row
RECORD_CANDIDATES = 10  # candidates per training row, the answer included
NOT_ANSWERABLE = "N/A"


def _std(name: str | Column) -> Column:
    return standardize_punctuation(F.col(name) if isinstance(name, str) else name)


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _guid(set_type: str, *parts) -> Column:
    return F.concat_ws("-", F.lit(set_type), *parts)


def _example(guid: Column, text_a: Column, text_b: Column | None = None, label: Column | None = None, idx: Column | None = None, num_choices=1, meta: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    columns = [
        guid.alias("guid"),
        text_a.alias("text_a"),
        (none if text_b is None else text_b).alias("text_b"),
        (none if label is None else label.cast("string")).alias("label"),
        (F.lit("-1") if idx is None else idx.cast("string")).alias("idx"),
        (num_choices if isinstance(num_choices, Column) else F.lit(num_choices)).cast("int").alias("num_choices"),
    ]
    return columns + ([meta.alias("meta")] if meta is not None else [])


def _whole(passage: Column) -> Column:
    return passage


def labelled_or_first(examples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Unlabelled rows get the first label, so that they can be laid out like the others."""
    return examples.withColumn("label", F.coalesce("label", F.lit(str(labels[0]))))


def entailment(raw: DataFrame, set_type: str, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """Premise and hypothesis; an id that is no number becomes the line number."""
    idx = F.coalesce(F.col("idx").cast("string").try_cast("bigint"), F.col("line_no").cast("bigint"))
    return raw.select(_example(_guid(set_type, idx.cast("string")), _std(premise), _std(hypothesis), _optional(raw, "label"), idx))


def word_in_context(raw: DataFrame, set_type: str) -> DataFrame:
    label = F.when(F.coalesce(F.col("label"), F.lit(False)), "true").otherwise("false")
    idx = F.col("idx").cast("bigint")
    return raw.select(_example(_guid(set_type, idx.cast("string")), _std("sentence1"), _std("sentence2"), label, idx, meta=F.struct("word")))


def word_in_context_text(examples: DataFrame) -> DataFrame:
    """Classifier form: the word in front of the first sentence."""
    return examples.withColumn("text_a", F.concat("meta.word", F.lit(": "), "text_a"))


def _shifted(matches: Callable[[Column], Column], at: Column) -> Column:
    """`at` when it matches, else the neighbour that does, the left one first."""
    return F.when(matches(at), at).when((at >= 1) & matches(at - 1), at - 1).when(matches(at + 1), at + 1).otherwise(at)


def pronoun_spans(raw: DataFrame) -> DataFrame:
    """Repair span indexes that are off by one, and split a word that starts with the pronoun.

    Adds the words, both indexes, distinct candidates, and whether the pronoun is where its index says.
    """
    df = raw.withColumn("__text", _std("text"))
    df = df.withColumns({
        "__w": split_words(F.col("__text")),
        "__lower": split_words(F.lower("__text")),
        "__s1": split_words(F.lower("target.span1_text")),
        "__s2": F.col("target.span2_text"),
    })
    spans_at = lambda i: F.slice("__lower", i + 1, F.size("__s1")) == F.col("__s1")
    pronoun_at = lambda i: F.coalesce(F.get("__w", i) == F.col("__s2"), F.lit(False))
    df = df.withColumns({
        "span1_index": _shifted(spans_at, F.col("target.span1_index")),
        "span2_index": _shifted(pronoun_at, F.col("target.span2_index")),
    })
    at = F.col("span2_index")
    word = F.get("__w", at)
    cut = F.concat(A.head(F.col("__w"), at), F.array(F.col("__s2"), word.substr(F.length("__s2") + 1, F.length(word))), A.drop(F.col("__w"), at + 1))
    df = df.withColumn("words", F.when(~pronoun_at(at) & F.coalesce(word.startswith(F.col("__s2")), F.lit(False)), cut).otherwise(F.col("__w")))
    df = df.withColumn("aligned", F.coalesce(F.get("words", at) == F.col("__s2"), F.lit(False)))
    names = F.array_distinct(F.transform("candidates", lambda c: c["text"])) if "candidates" in raw.columns else F.lit(None).cast("array<string>")
    return df.withColumn("names", names).drop("__text", "__w", "__lower", "__s1", "__s2")


def _pronoun_meta(candidates: Column) -> Column:
    return F.struct(
        F.col("target.span1_text").alias("span1_text"), F.col("target.span2_text").alias("span2_text"),
        F.col("span1_index"), F.col("span2_index"), candidates.alias("candidates"), F.col("aligned"))


def pronoun_choice(raw: DataFrame, set_type: str, cloze: bool = True, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """Pronoun resolution. Training keeps true rows; many candidates are dealt into groups of nine, the last group topped up
    from the front."""
    df = pronoun_spans(raw).withColumn("__text", carry(F.array_join("words", " ")))  # once for all rows of a text
    label = F.initcap(_optional(raw, "label"))
    if set_type == "train" and cloze:
        df = df.filter(label == "True")
    size = F.size("names")
    if set_type == "train":
        def group(k: Column) -> Column:
            part = A.take(F.col("names"), k * WSC_CANDIDATES, WSC_CANDIDATES)
            return F.concat(part, A.head(F.col("names"), WSC_CANDIDATES - F.size(part)))

        many = F.transform(A.counting(0, F.ceil(size / WSC_CANDIDATES).cast("int")), group)
        groups = F.when(F.coalesce(size, F.lit(0)) > WSC_CANDIDATES, many).otherwise(F.array("names"))
    else:
        groups = F.array("names")
    rows = df.select("*", F.posexplode(groups).alias("group_no", "group"))
    meta = _pronoun_meta(F.col("group"))
    columns = _example(_guid(set_type, F.col("idx").cast("string")), F.col("__text"), None, label, F.col("idx"), meta=meta)
    return rows.select(*columns, "group_no")


def pronoun_pairs(raw: DataFrame, set_type: str, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """Pronoun resolution as sentence and antecedent; true training rows add one false row per candidate."""
    df = pronoun_spans(raw).withColumn("__text", carry(F.array_join("words", " ")))  # once for all rows of a text
    label = F.initcap(_optional(raw, "label"))
    own = F.struct(F.col("target.span1_text").alias("text_b"), label.alias("label"))
    rows = F.array(own)
    if set_type == "train":
        wrong = F.transform("names", lambda n: F.struct(n.alias("text_b"), F.lit("False").alias("label")))
        rows = F.when(label == "True", F.concat(rows, F.coalesce(wrong, F.array().cast("array<struct<text_b:string,label:string>>")))).otherwise(rows)
    df = df.withColumn("row", F.explode(rows))
    meta = _pronoun_meta(F.lit(None).cast("array<string>"))
    return df.select(_example(_guid(set_type, F.col("idx").cast("string")), F.col("__text"), F.col("row.text_b"), F.col("row.label"), F.col("idx"), meta=meta))


def mark_word(text: Column, index: Column, mark: str = "*") -> Column:
    """Wrap the word at `index` in a mark."""
    return F.array_join(F.transform(split_words(text), lambda w, i: F.when(i == index, F.concat(F.lit(mark), w, F.lit(mark))).otherwise(w)), " ")


def yes_no_question(raw: DataFrame, set_type: str) -> DataFrame:
    return raw.select(_example(_guid(set_type, F.col("idx").cast("string")), _std("passage"), _std("question"), F.lower(_optional(raw, "label")), F.col("idx")))


def cause_and_effect(raw: DataFrame, set_type: str) -> DataFrame:
    """Premise with two choices; training and unlabelled sets add a mirrored copy of every row."""
    def rows(first: str, second: str, label: Column, suffix: str, idx: Column) -> DataFrame:
        meta = F.struct(F.col(first).alias("choice1"), F.col(second).alias("choice2"), "question")
        guid = F.concat(_guid(set_type, F.col("idx").cast("string")), F.lit(suffix))
        return raw.select(_example(guid, F.col("premise"), None, label, idx, meta=meta))

    given = _optional(raw, "label")
    examples = rows("choice1", "choice2", given, "", F.col("idx"))
    if set_type not in ("train", "unlabeled"):
        return examples
    mirrored = F.when(given == "0", "1").otherwise("0")
    return examples.unionByName(rows("choice2", "choice1", mirrored, "m", F.lit("-1")))


def cause_and_effect_layout_text(examples: DataFrame) -> DataFrame:
    """Classifier form: one row per choice, the premise followed by its connective."""
    joiner = F.when(F.col("meta.question") == "cause", "because").otherwise("so")
    text_a = F.concat(_std("text_a"), F.lit(" "), joiner)
    choices = F.array(_std("meta.choice1"), _std("meta.choice2"))
    return examples.select("guid", text_a.alias("text_a"), "label", F.posexplode(choices).alias("choice_no", "text_b"))


def answer_sentences(raw: DataFrame, set_type: str, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """Passage, question and one answer per row. Questions are put in form before the rows of their answers are made."""

    def rows(q: Column, place: Column) -> Column:
        return F.transform(q["answers"], lambda a: F.struct(
            place.alias("place"), q["idx"].alias("q"), a["idx"].alias("a"), a["label"].alias("label"), _std(a["text"]).alias("answer")))

    # Rows have the place of their question: with its text in each of them, the array would be as long as the line times its answers.
    passages = raw.select(
        "idx", carry(_std("passage.text")).alias("text"), F.transform("passage.questions", lambda q: _std(q["question"])).alias("questions"),
        F.flatten(F.transform("passage.questions", rows)).alias("rows"))  # the text once, before its rows
    answers = A.exploded(passages, ["idx", "text", "questions"], F.col("rows"), "r").select("idx", "text", F.get("questions", F.col("r.place")).alias("question"), "r.*")
    meta = F.struct(F.col("idx").alias("passage_idx"), F.col("q").alias("question_idx"), F.col("a").alias("answer_idx"), "answer")
    number = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("null"))
    guid = F.concat(F.lit(f"{set_type}-p"), number("idx"), F.lit("-q"), number("q"), F.lit("-a"), number("a"))
    idx = F.concat_ws(",", *[F.col(c).cast("string") for c in ("idx", "q", "a")])
    return answers.select(_example(guid, F.col("text"), F.col("question"), F.col("label"), idx, meta=meta))


def answer_sentences_text(examples: DataFrame) -> DataFrame:
    """Classifier form: question and answer in one text."""
    return examples.withColumn("text_b", F.concat_ws(" ", "text_b", F.lit("answer:"), "meta.answer"))


def reading_choice(raw: DataFrame, set_type: str, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """One row per question of an article, with its options."""
    articles = raw.select("id", carry(clean_spaces(F.col("article"))).alias("text"), F.arrays_zip("questions", "options", "answers").alias("qs"))
    rows = articles.select("id", "text", F.posexplode("qs").alias("q_no", "q"))
    meta = F.struct(F.col("q.options").alias("choices"))
    idx = F.concat_ws(",", F.lit(set_type), F.col("id").cast("string"), F.col("q_no").cast("string"))
    guid = F.concat(F.lit(f"{set_type}-p"), F.col("id").cast("string"), F.lit("-q"), F.col("q_no").cast("string"))
    return rows.select(_example(guid, F.col("text"), F.col("q.questions"), F.col("q.answers"), idx, meta=meta))


def _distinct_below(count: int, bound: Column, seed: str | int, *keys: Column | str) -> Column:
    """`count` distinct numbers below `bound` (more than `count`), every set of them equally likely (Floyd's draws)."""
    none = F.array().cast("array<bigint>")

    def step(chosen: Column, i: Column) -> Column:
        last = bound - count + i
        return A.let(hash_below(last, seed, *keys, i), lambda t: F.array_append(chosen, F.when(F.array_contains(chosen, t), last - 1).otherwise(t).cast("bigint")))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.lit(count).cast("bigint")), none, step)


def _wrong_entities(entities: Column, answers: Column, count: int, *keys: Column | str, seed: str | int) -> Column:
    """Up to `count` random entities that are no answer. Places are drawn, so entities are neither copied nor sorted for a question."""

    def pick(found: Column) -> Column:
        size = (F.size(entities) - F.size(found)).cast("bigint")
        skip = lambda k: F.aggregate(found, k, lambda at, p: F.when(at >= p - 1, at + 1).otherwise(at))
        drawn = F.transform(_distinct_below(count, size, seed, *keys), lambda k: F.get(entities, skip(k).cast("int")))
        return F.when(size > count, drawn).otherwise(F.array_except(entities, answers))

    return A.let(F.array_sort(F.filter(F.transform(answers, lambda a: F.array_position(entities, a)), lambda p: p > 0)), pick)


def entity_cloze(raw: DataFrame, set_type: str, seed: str | int = 42, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """Entity cloze. Training: a row per answer with up to nine random wrong entities; else one row with all candidates."""
    df = raw.withColumn("__text", _std("passage.text"))
    chars = F.filter(F.split("__text", ""), lambda c: c != "")
    spans = A.let(chars, lambda cs: F.transform("passage.entities", lambda e: _std(F.array_join(A.take(cs, e["start"], e["end"] - e["start"] + 1), ""))))
    df = df.select("idx", carry(highlights_as_list(F.col("__text"))).alias("text"), F.array_sort(F.array_distinct(spans)).alias("entities"), "qas")
    answers = lambda q: F.array_sort(F.array_distinct(F.transform(F.coalesce(q["answers"], F.array().cast("array<struct<text:string>>")), lambda a: _std(a["text"]))))
    base = F.format_string(f"{set_type}-p%d-q%d", F.col("idx"), F.col("q_idx"))
    if set_type != "train":
        questions = F.transform("qas", lambda q: F.struct(q["idx"].alias("q_idx"), _std(q["query"]).alias("question"), answers(q).alias("answers")))
        rows = df.select("idx", "text", "entities", F.explode(questions).alias("r")).select("idx", "text", "entities", "r.*")
        meta = F.struct(F.col("idx").alias("passage_idx"), F.col("q_idx").alias("question_idx"), F.col("entities").alias("candidates"), "answers")
        return rows.select(_example(base, F.col("text"), F.col("question"), F.lit("1"), F.col("q_idx"), F.size("entities"), meta))

    def per_answer(q: Column) -> Column:
        def row(own: Column, question: Column) -> Column:
            return F.transform(own, lambda answer, a_no: F.struct(
                q["idx"].alias("q_idx"), question.alias("question"), a_no.alias("a_no"), answer.alias("answer"),
                F.concat(F.array(answer), _wrong_entities(F.col("entities"), own, RECORD_CANDIDATES - 1, F.col("idx"), q["idx"], a_no, seed=seed)).alias("candidates")))

        return A.let(answers(q), lambda own: A.let(_std(q["query"]), lambda question: row(own, question)))

    rows = df.select("idx", "text", F.explode(F.flatten(F.transform("qas", per_answer))).alias("r")).select("idx", "text", "r.*")
    meta = F.struct(F.col("idx").alias("passage_idx"), F.col("q_idx").alias("question_idx"), "candidates", F.array("answer").alias("answers"))
    guid = F.concat(base, F.lit("-a"), F.col("a_no").cast("string"))
    idx = F.concat_ws(",", F.col("idx").cast("string"), F.col("q_idx").cast("string"), F.col("a_no").cast("string"))
    return rows.select(_example(guid, F.col("text"), F.col("question"), F.lit("0"), idx, F.size("candidates"), meta))


def table_rows(raw: DataFrame, set_type: str, text_a: str, text_b: str | None = None, label: str | None = "label", standardize: bool = True, with_idx: bool = False) -> DataFrame:
    """One or two text columns of a table, numbered by row; a missing label column leaves the label empty."""
    form = _std if standardize else F.col
    line = F.col("line_no").cast("string")
    return raw.select(_example(
        _guid(set_type, line), form(text_a), None if text_b is None else form(text_b), _optional(raw, label) if label else None, line if with_idx else None))


def topic_news(raw: DataFrame, set_type: str) -> DataFrame:
    plain = lambda c: _std(F.replace(F.col(c), F.lit("\\"), F.lit(" ")))
    return raw.select(_example(_guid(set_type, F.col("line_no").cast("string")), plain("headline"), plain("body"), F.col("label")))


def topic_question(raw: DataFrame, set_type: str) -> DataFrame:
    text_a = _std(F.concat(clean_review(F.col("title")), F.lit(" "), clean_review(F.col("body"))))
    return raw.select(_example(_guid(set_type, F.col("line_no").cast("string")), text_a, _std(clean_review(F.col("answer"))), F.col("label")))


def review(raw: DataFrame, set_type: str) -> DataFrame:
    return raw.select(_example(_guid(set_type, F.col("line_no").cast("string")), _std(clean_review(F.col("body"))), None, F.col("label")))


def stance(raw: DataFrame, set_type: str = "train", language: str | None = None) -> DataFrame:
    kept = raw if language is None else raw.filter(F.col("language") == language)
    return kept.select(_example(F.col("id").cast("string"), _std("question"), _std("comment"), F.col("label")))


def pronoun_by_character(raw: DataFrame, set_type: str) -> DataFrame:
    """Pronoun resolution with character indexes; keeps the lengths of both spans."""
    idx = F.col("id").cast("string")
    meta = F.struct(
        "target.span1_text", "target.span2_text", "target.span1_index", "target.span2_index",
        F.length("target.span1_text").alias("span1_length"), F.length("target.span2_text").alias("span2_length"))
    return raw.select(_example(_guid(set_type, idx), F.col("text"), F.col("target.span1_index").cast("string"), _optional(raw, "label"), idx, meta=meta))


def _questions(raw: DataFrame, carry: Callable[[Column], Column]) -> DataFrame:
    paragraphs = A.exploded(A.exploded(raw, [], F.col("data"), "d"), [], F.col("d.paragraphs"), "p")
    return A.exploded(paragraphs.select(carry(F.col("p.context")).alias("context"), "p.qas"), ["context"], F.col("qas"), "qa")


def passage_cloze(raw: DataFrame, set_type: str, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """First answer of every question, or the mark of an unanswerable one."""
    first = F.coalesce(F.get("qa.answers", F.lit(0))["text"], F.lit(NOT_ANSWERABLE))
    meta = F.struct(first.alias("answer"), F.transform("qa.answers", lambda a: a["text"]).alias("answers"))
    return _questions(raw, carry).select(_example(F.col("qa.id"), F.col("context"), F.col("qa.question"), F.lit("0"), meta=meta))


# Length of the split prefix in front of the number in a context id.
CONTEXT_PREFIX = {"train": 6, "dev": 4, "test": 6}


def passage_cloze_numbered(raw: DataFrame, set_type: str, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """Question rows of a passage whose number stands behind a prefix in its id."""
    number = F.expr(f"cast(substring(context_id, {CONTEXT_PREFIX[set_type] + 1}) as bigint)").cast("string")
    passages = raw.select(number.alias("number"), carry(F.col("context_text")).alias("context_text"), "qas")
    rows = passages.select("number", "context_text", F.posexplode("qas").alias("q_no", "q"))
    guid = _guid(set_type, F.col("number"), F.col("q_no").cast("string"))
    return rows.select(_example(guid, F.col("context_text"), F.col("q.query_text"), F.lit("0"), meta=F.struct(F.get("q.answers", F.lit(0)).alias("answer"))))


def paired_texts(pairs: DataFrame, set_type: str, source_rule: Callable[[Column], Column] = lambda c: c, target_rule: Callable[[Column], Column] | None = None, standardize: bool = True) -> DataFrame:
    """Source and target texts with a normalization rule each; the reference text is kept in `meta.ref`."""
    rule = target_rule or source_rule
    form = _std if standardize else (lambda c: c)
    target = rule(form(F.col("target")))
    return pairs.select(_example(_guid(set_type, F.col("line_no").cast("string")), source_rule(form(F.col("source"))), target, meta=F.struct(target.alias("ref"))))


def answer_generation(raw: DataFrame, set_type: str, fake_answer: str = "FAKE_ANSWER", carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """One row per distinct answer of a question; the test set gets one placeholder answer."""
    answers = F.array(F.lit(fake_answer)) if set_type == "test" else F.array_distinct(F.transform("qa.answers", lambda a: a["text"]))
    rows = _questions(raw, carry).select("context", "qa", F.explode(answers).alias("answer"))
    meta = F.struct(F.col("qa.question").alias("question"), "answer", F.col("answer").alias("ref"))
    guid = _guid(set_type, F.col("qa.id"), F.col("answer"))
    return rows.select(_example(guid, F.col("context"), None, idx=F.col("qa.id"), meta=meta))


def question_generation(raw: DataFrame, set_type: str, carry: Callable[[Column], Column] = _whole) -> DataFrame:
    """One row per distinct answer text; of several start positions of one text the last counts."""

    def last_of_each(answers: Column) -> Column:
        # Sorted by text and place, so a question takes n log n for its answers; a row carries none but its own.
        placed = F.sort_array(F.transform(answers, lambda a, i: F.struct(a["text"].alias("text"), i.alias("i"), a["answer_start"].alias("answer_start"))))
        return A.let(placed, lambda ps: F.filter(ps, lambda p, i: (i == F.size(ps) - 1) | ~F.get(ps, i + 1)["text"].eqNullSafe(p["text"])))

    rows = A.exploded(_questions(raw, carry), ["context", "qa.id", "qa.question"], last_of_each(F.col("qa.answers")), "a")
    meta = F.struct("question", F.col("a.text").alias("answer"), F.col("a.answer_start").alias("answer_start"))
    return rows.select(_example(_guid(set_type, F.col("id"), F.col("a.text")), F.col("context"), None, idx=F.col("id"), meta=meta))


def multiple_choice(raw: DataFrame, keys: Sequence[str], encode: Callable[[Column], Column], mask: int, length: int, bidirectional: bool = True) -> DataFrame:
    """One row per choice: the input's tokens with a mask, cut at the front so that the longest choice fits."""
    df = raw.select(*keys, encode(F.col("inputs_pretokenized")).alias("inputs"), F.transform("choices_pretokenized", encode).alias("choices"),
                    F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"))
    if bidirectional:
        df = df.withColumn("inputs", F.when(F.array_contains("inputs", mask), F.col("inputs")).otherwise(F.concat("inputs", F.array(F.lit(mask)))))
    longest = F.array_max(F.transform("choices", lambda c: F.size(c)))
    df = df.withColumn("__room", F.lit(length - 2) - longest)
    df = df.withColumn("inputs", F.when(F.size("inputs") > F.col("__room"), A.tail(F.col("inputs"), F.col("__room"))).otherwise(F.col("inputs")))
    return df.select(*keys, "inputs", "label", F.posexplode("choices").alias("choice_no", "choice"))


def label_distribution(examples: DataFrame) -> DataFrame:
    return examples.groupBy("label").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Task:
    """A benchmark: its builder and its labels. A new task is one more entry in TASKS and its patterns."""

    build: Callable[..., DataFrame]
    labels: tuple[str, ...] = ()


YES_NO = ("false", "true")
BINARY = ("0", "1")
TASKS: dict[str, Task] = {
    "rte": Task(entailment, ("entailment", "not_entailment")),
    "ax-g": Task(entailment, ("entailment", "not_entailment")),
    "ax-b": Task(partial(entailment, premise="sentence1", hypothesis="sentence2"), ("entailment", "not_entailment")),
    "cb": Task(entailment, ("entailment", "contradiction", "neutral")),
    "wic": Task(word_in_context, YES_NO),
    "wsc": Task(pronoun_choice, ("False", "True")),
    "wsc1": Task(pronoun_pairs, ("False", "True")),
    "boolq": Task(yes_no_question, YES_NO),
    "copa": Task(cause_and_effect, BINARY),
    "multirc": Task(answer_sentences, BINARY),
    "race": Task(reading_choice, ("A", "B", "C", "D")),
    "record": Task(entity_cloze, BINARY),
    "mnli": Task(partial(table_rows, text_a="sentence1", text_b="sentence2", label="gold_label"), ("contradiction", "entailment", "neutral")),
    "mnli-mm": Task(partial(table_rows, text_a="sentence1", text_b="sentence2", label="gold_label"), ("contradiction", "entailment", "neutral")),
    "sst2": Task(partial(table_rows, text_a="sentence"), BINARY),
    "cola": Task(partial(table_rows, text_a="text"), BINARY),
    "mrpc": Task(partial(table_rows, text_a="#1 String", text_b="#2 String", label="Quality"), BINARY),
    "qqp": Task(partial(table_rows, text_a="question1", text_b="question2", label="is_duplicate"), BINARY),
    "qnli": Task(partial(table_rows, text_a="question", text_b="sentence"), ("entailment", "not_entailment")),
    "agnews": Task(topic_news, tuple(str(i) for i in range(1, 5))),
    "yahoo": Task(topic_question, tuple(str(i) for i in range(1, 11))),
    "yelp-polarity": Task(review, ("1", "2")),
    "yelp-full": Task(review, tuple(str(i) for i in range(1, 6))),
    "xstance": Task(stance, ("FAVOR", "AGAINST")),
    "xstance-de": Task(partial(stance, language="de"), ("FAVOR", "AGAINST")),
    "xstance-fr": Task(partial(stance, language="fr"), ("FAVOR", "AGAINST")),
    "tnews": Task(
        partial(table_rows, text_a="sentence", text_b="keywords", standardize=False, with_idx=True),
        ("100", "101", "102", "103", "104", "106", "107", "108", "109", "110", "112", "113", "114", "115", "116")),
    "afqmc": Task(partial(table_rows, text_a="sentence1", text_b="sentence2", standardize=False, with_idx=True), BINARY),
    "cluewsc": Task(pronoun_by_character, YES_NO),
    "squad": Task(passage_cloze, ("0",)),
    "qa-cn": Task(passage_cloze_numbered, ("0",)),
}
