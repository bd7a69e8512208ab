"""Patterns and verbalizers: examples to prompts with one mask.

A pattern is data: a list of literal and field parts on two sides, some of which may be shortened, plus slots for learned
prompt tokens. There are a few patterns per task, so a pattern becomes an array of part columns inside the example's row;
rendering and truncation need no join and no shuffle.

Template notation: `{name}` is a field, `{+name}` a field that may be shortened, `{mask}` the mask, `~` a learned-prompt slot,
`|` starts the second side, and `{}` ends one literal part and starts the next.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions import arrays as A
from tokenmill.functions.text import lower_first, split_words, strip_final_punctuation
from tokenmill.operators.examples import mark_word
from tokenmill.operators.sequences import pair_losses

Part = tuple[str, str, str, bool]  # side, kind (text, field, mask, slot), value, shortenable


def parts_of(template: str) -> list[Part]:
    parts: list[Part] = []
    side = "a"
    for piece in re.split(r"(\{[^}]*\}|~|\|)", template):
        if piece == "|":
            side = "b"
        elif piece == "~":
            parts.append((side, "slot", "", False))
        elif piece == "{mask}":
            parts.append((side, "mask", "", False))
        elif piece.startswith("{") and piece != "{}":
            name = piece[1:-1]
            parts.append((side, "field", name.lstrip("+"), name.startswith("+")))
        elif piece and piece != "{}":
            parts.append((side, "text", piece, False))
    return parts


def _a() -> Column:
    return F.col("text_a")


def _b() -> Column:
    return F.col("text_b")


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), text)


def _bare_lower(text: Column) -> Column:
    return strip_final_punctuation(lower_first(text))


@dataclass(frozen=True)
class Prompt:
    """Patterns of a task by id, its fields, its label words by pattern id, and its answers when the choices are texts.

    Rows that pass `guard` use the patterns of the task named by `guarded` instead.
    """

    patterns: dict[int, str]
    fields: Callable[[], dict[str, Column]]
    words: dict[int, dict[str, str]] = field(default_factory=dict)
    answers: Callable[[], Column] | None = None
    guard: Callable[[], Column] | None = None
    guarded: str = ""


def _plain_fields() -> dict[str, Column]:
    return {"a": _a(), "b": _b()}


def _copa_fields() -> dict[str, Column]:
    first, second = _bare_lower(F.col("meta.choice1")), _bare_lower(F.col("meta.choice2"))
    return {
        "premise": strip_final_punctuation(_spaced(_a())), "bare_premise": strip_final_punctuation(_a()),
        "choice1": first, "choice2": second, "spaced2": _spaced(second),
        "joiner": F.when(F.col("meta.question") == "cause", " because").otherwise(", so"),
    }


def _wsc_fields() -> dict[str, Column]:
    pronoun = F.col("meta.span2_text")
    return {
        "text": mark_word(_a(), F.col("meta.span2_index")),
        "refers": F.concat(F.lit(" The pronoun '*"), pronoun, F.lit("*' refers to")),
        "previous": F.concat(F.lit(" In the previous sentence, the pronoun '*"), pronoun, F.lit("*' refers to")),
        "asks": F.concat(F.lit(" Question: In the passage above, what does the pronoun '*"), pronoun, F.lit("*' refer to?")),
    }


def _record_fields() -> dict[str, Column]:
    halves = F.split(_b(), "@placeholder", 2)
    return {"a": _a(), "left": _spaced(_rstrip(halves[0])), "right": F.get(halves, F.lit(1))}


def _race_fields() -> dict[str, Column]:
    halves = F.split(_spaced(_b()), "_", 2)
    left = _rstrip(halves[0])
    return {"a": _a(), "question": _spaced(_b()), "left": left, "lower_left": lower_first(left), "right": F.coalesce(F.get(halves, F.lit(1)), F.lit(""))}


def _entailment_fields() -> dict[str, Column]:
    bare = strip_final_punctuation(_b())
    return {"a": _a(), "spaced_a": _spaced(_a()), "b": bare, "spaced_b": _spaced(bare)}


def _cb_fields() -> dict[str, Column]:
    return {**_entailment_fields(), "full_b": _spaced(_b())}


def _boolq_fields() -> dict[str, Column]:
    return {"a": _a(), "spaced_a": _spaced(_a()), "spaced_b": _spaced(_b())}


def _multirc_fields() -> dict[str, Column]:
    question = strip_final_punctuation(_rstrip(_b()))
    answer = F.col("meta.answer")
    return {
        "passage": strip_final_punctuation(_rstrip(_a())), "question": _spaced(question),
        "asked": F.concat(F.lit(" "), question, F.lit("?")), "answer": answer, "spaced_answer": _spaced(answer),
    }


def _wic_fields() -> dict[str, Column]:
    word = F.col("meta.word")
    return {
        "a": _a(), "b": _b(), "spaced_b": _spaced(_b()), "word": word,
        "both": F.concat(F.lit('"'), _a(), F.lit('" / "'), _b(), F.lit('"')),
        "sense": F.concat(F.lit(' Similar sense of "'), word, F.lit('"?')),
        "does": F.concat(F.lit(" Does "), word, F.lit(" have the same meaning in both sentences?")),
    }


def _mnli_fields() -> dict[str, Column]:
    return {"a": strip_final_punctuation(_a()), "b": _b()}


def _mrpc_fields() -> dict[str, Column]:
    return {"a": _a(), "lower_b": lower_first(_b()), "bare_b": _bare_lower(_b())}


def _qnli_fields() -> dict[str, Column]:
    return {"b": _b(), "spaced_b": _spaced(_b()), "question": _spaced(strip_final_punctuation(_a()))}


def _spans_marked() -> Column:
    """Characters with * around the pronoun and # around the target; where both touch, # goes outside."""
    m = lambda name: F.col(f"meta.{name}")
    pronoun_end, target_end = m("span2_index") + m("span2_length") - 1, m("span1_index") + m("span1_length") - 1
    # Where a mark stands, and its rank there: marks behind a character come before marks in front of the next one.
    places = [(pronoun_end, 1, 0, "*"), (target_end, 1, 1, "#"), (m("span1_index"), 0, 2, "#"), (m("span2_index"), 0, 3, "*")]
    text, size = _a(), F.length(_a())
    marks = F.array(*[F.when((i >= 0) & (i < size), F.struct((i + behind).alias("at"), F.lit(rank).alias("rank"), F.lit(mark).alias("mark"))) for i, behind, rank, mark in places])

    def cut(found: Column) -> Column:
        before = lambda k: F.when(k > 0, F.get(found, k - 1)["at"]).otherwise(0)
        pieces = F.transform(found, lambda x, k: F.concat(text.substr(before(k) + 1, x["at"] - before(k)), x["mark"]))
        return F.concat(F.array_join(pieces, ""), text.substr(before(F.size(found)) + 1, size))

    return A.let(F.sort_array(F.filter(marks, lambda x: x.isNotNull())), cut)


def _cluewsc_fields() -> dict[str, Column]:
    pronoun = F.concat(F.lit("代词'*"), F.col("meta.span2_text"), F.lit("*'"))
    target = F.col("meta.span1_text")
    return {"text": _spans_marked(), "pronoun": pronoun, "is": F.concat(F.lit("指#"), target, F.lit("#.")), "is_quoted": F.concat(F.lit("指'#"), target, F.lit("#'."))}


def _qa_cn_fields() -> dict[str, Column]:
    return {"a": _a(), "told": F.concat(F.lit("根据以下信息："), _a()), "asked": F.concat(F.lit("请问，"), _b())}


def _spaced_choices(name: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(f"meta.{name}"), lambda c: F.concat(F.lit(" "), c))


def _same(words: dict[str, str], ids: int) -> dict[int, dict[str, str]]:
    return dict.fromkeys(range(ids), words)


# Fixed values from here on: patterns and label words of every task.
_NO_YES = {"not_entailment": " No", "entailment": " Yes"}
_RTE_PATTERNS = {
    0: '~"{+b}" ?|~{mask},~ "{+a}"',
    1: "~{+b}?|~{mask},~{+spaced_a}",
    2: '~"{+b}" ?|~{mask}. "~{+a}"',
    3: "~{+b}?|~{mask}.~{+spaced_a}",
    4: "~{+a}~ question:{+spaced_b} True or False?~ answer:{mask}",
}
_TOPIC_PATTERNS = {
    0: "{mask}:{+a}{+b}",
    2: "{+a}({mask}){+b}",
    3: "{+a}{+b}({mask})",
    4: "[ Category:{mask}]{+a}{+b}",
    5: "{mask}-{+a}{+b}",
}
_REVIEW_PATTERNS = {
    0: "It was{mask}.{+a}",
    1: "{+a}. All in all, it was{mask}.",
    2: "Just{mask}!|{+a}",
    3: "{+a}| In summary, the restaurant is{mask}.",
}
_STANCE_WORDS = [("Ja", "Nein"), ("Yes", "No"), ("Oui", "Non")]

PROMPTS: dict[str, Prompt] = {
    "copa": Prompt(
        {
            0: '~"{choice1}" or "{choice2}"?~{+premise}{joiner}~{mask}.',
            1: "~{choice1} or{spaced2}?~{+premise}{joiner}~{mask}.",
            2: '~"{choice1}" or "{choice2}"~{+premise}{joiner}{mask}.~',
        },
        _copa_fields,
        answers=lambda: F.array(_spaced(_bare_lower(F.col("meta.choice1"))), _spaced(_bare_lower(F.col("meta.choice2")))),
    ),
    "wsc": Prompt(
        {0: "~{+text}~{refers}~{mask}.", 1: "~{+text}~{previous}~{mask}.", 2: "~{+text}~{asks}~ Answer:{mask}."},
        _wsc_fields,
        answers=lambda: F.transform(
            F.concat(F.array("meta.span1_text"), F.coalesce("meta.candidates", F.array().cast("array<string>"))), lambda c: F.concat(F.lit(" "), c)),
    ),
    "record": Prompt({0: "{+a}{left}{mask}{right}"}, _record_fields, answers=_spaced_choices("candidates")),
    "race": Prompt(
        {
            0: "{+a}| Question:{+question} Answer:{mask}",
            1: "{+a}| Based on the previous passage,{+question}{mask}",
        },
        _race_fields,
        answers=_spaced_choices("choices"),
        guard=lambda: F.contains(_b(), F.lit("_")),
        guarded="race-blank",
    ),
    "race-blank": Prompt(
        {0: "{+a}|{+left}{mask}{+right}", 1: "{+a}| Based on the previous passage,{+lower_left}{mask}{+right}"},
        _race_fields,
        answers=_spaced_choices("choices"),
    ),
    "rte": Prompt(_RTE_PATTERNS, _entailment_fields, {**_same(_NO_YES, 4), 4: {"entailment": " true", "not_entailment": " false"}}),
    "cb": Prompt(
        {**_RTE_PATTERNS, 4: "~{+a}~ question:{+full_b} true, false or neither?~ answer:{mask}"},
        _cb_fields,
        {
            **_same({"contradiction": " No", "entailment": " Yes", "neutral": " Maybe"}, 4),
            4: {"contradiction": " false", "entailment": " true", "neutral": " neither"},
        },
    ),
    "boolq": Prompt(
        {
            **dict.fromkeys((0, 1), "~{+a}~ Question:{+spaced_b}? Answer:~{mask}."),
            **dict.fromkeys((2, 3), "~{+a} Based on the previous passage,~{+spaced_b}?~{mask}."),
            **dict.fromkeys((4, 5), "Based on the following passage~{+spaced_b}?~{mask}.~{+spaced_a}"),
        },
        _boolq_fields,
        {**dict.fromkeys((0, 2, 4), {"false": " No", "true": " Yes"}), **dict.fromkeys((1, 3, 5), {"false": " false", "true": " true"})},
    ),
    "multirc": Prompt(
        {
            0: "{+passage}.~ Question:{asked}~ Is it{spaced_answer}?~{mask}.",
            1: '{+passage}.~ Question:{question}?~ Is the correct answer "{answer}"?~{mask}.',
            2: '{+passage}. Based on the previous passage,~{question}?~ Is "{answer}" a correct answer?~{mask}.',
            3: "~{+passage}~{question}- [{mask}]~{answer}",
            4: "{+passage}.~ Question:{question}?~{spaced_answer}?~{mask}.",
        },
        _multirc_fields,
        {**_same({"0": " No", "1": " Yes"}, 5), 3: {"0": " False", "1": " True"}},
    ),
    "wic": Prompt(
        {
            0: "~{+both}~{sense}~{mask}.",
            1: "{+a}~{+spaced_b}~{does}~{mask}",
            2: '~{word} .~ Sense (1) (a) "{+a}"~ ({mask}) "{b}"',
        },
        _wic_fields,
        {**_same({"false": " No", "true": " Yes"}, 2), 2: {"false": "2", "true": "b"}},
    ),
    "agnews": Prompt(
        {**_TOPIC_PATTERNS, 1: "{mask} News:{+a}{+b}"}, _plain_fields,
        _same({"1": " World", "2": " Sports", "3": " Business", "4": " Tech"}, 6),
    ),
    "yahoo": Prompt(
        {**_TOPIC_PATTERNS, 1: "{mask} Question:{+a}{+b}"}, _plain_fields,
        _same({
            "1": " Society", "2": " Science", "3": " Health", "4": " Education", "5": " Computer", "6": " Sports",
            "7": " Business", "8": " Entertainment", "9": " Relationship", "10": " Politics",
        }, 6),
    ),
    "mnli": Prompt(
        {**dict.fromkeys((0, 2), '"{+a}" ?|{mask}, "{+b}"'), **dict.fromkeys((1, 3), "{+a}?|{mask},{+b}")}, _mnli_fields,
        {
            **dict.fromkeys((0, 1), {"contradiction": " Wrong", "entailment": " Right", "neutral": " Maybe"}),
            **dict.fromkeys((2, 3), {"contradiction": " No", "entailment": " Yes", "neutral": " Maybe"}),
        },
    ),
    "tnews": Prompt(
        {0: "标题：{+a}关键词：{+b}类别：{mask}"}, _plain_fields,
        _same({
            "100": "故事", "101": "文化", "102": "娱乐", "103": "体育", "104": "金融", "106": "居家", "107": "汽车", "108": "教育",
            "109": "科技", "110": "军事", "112": "旅游", "113": "世界", "114": "股票", "115": "农业", "116": "游戏",
        }, 1),
    ),
    "afqmc": Prompt({0: "{+a}？|你是说{+b}？{mask}。", 1: "{+a}？|{mask}，{+b}"}, _plain_fields, _same({"0": "▁不是", "1": "▁是"}, 2)),
    "yelp-polarity": Prompt(_REVIEW_PATTERNS, _plain_fields, _same({"1": " bad", "2": " good"}, 4)),
    "yelp-full": Prompt(_REVIEW_PATTERNS, _plain_fields, _same({"1": " terrible", "2": " bad", "3": " okay", "4": " good", "5": " great"}, 4)),
    "xstance": Prompt(
        {**dict.fromkeys((0, 2, 4), '"{+a}"|{mask}. "{+b}"'), **dict.fromkeys((1, 3, 5), "{+a}|{mask}.{+b}")}, _plain_fields,
        {i: dict(zip(("FAVOR", "AGAINST"), _STANCE_WORDS[i // 2])) for i in range(6)},
    ),
    "sst2": Prompt(dict.fromkeys((0, 1), "{+a} It was{mask}."), _plain_fields, {0: {"0": " terrible", "1": " great"}, 1: {"0": " bad", "1": " good"}}),
    "cola": Prompt({0: '"{+a}"{} This is{mask}.'}, _plain_fields, _same({"0": " incorrect", "1": " correct"}, 1)),
    "mrpc": Prompt({0: "{+a}|{mask}, {+lower_b}", 1: "{+a}| Does it mean that{+bare_b}?{mask}"}, _mrpc_fields, _same({"0": " No", "1": " Yes"}, 2)),
    "qqp": Prompt({0: "{+a}| Do you mean {+lower_b}{mask}.", 1: "{+a}|{mask}, {+lower_b}"}, _mrpc_fields, _same({"0": " No", "1": " Yes"}, 2)),
    "qnli": Prompt(
        {
            0: "{+b} Question:{+question}? Do you know the answer?{mask}.",
            1: "{+b} Based on the previous passage, do you know the answer{+question}?{mask}.",
            2: "Based on the following passage, do you know the answer{+question}?{mask}.{+spaced_b}",
        },
        _qnli_fields, _same(_NO_YES, 3),
    ),
    "squad": Prompt({0: "{+a}{question}{mask}."}, lambda: {"a": _a(), "question": _spaced(_b())}, answers=lambda: F.array(_spaced(F.col("meta.answer")))),
    "cluewsc": Prompt(
        {0: "~{+text}{pronoun}{mask}{is}", 1: "在如下的句子中：{+text}{pronoun}{mask}{is_quoted}"}, _cluewsc_fields,
        _same({"false": "不是", "true": "是"}, 2),
    ),
    "qa-cn": Prompt({0: "{+a}{asked}{mask}。", 1: "{told}{asked}{mask}。"}, _qa_cn_fields, answers=lambda: F.array("meta.answer")),
}
# Connective form of copa: the choice is part of the text and the connecting word is the answer.
COPA_CONNECTIVE = '"{choice1}" or "{choice2}"?{+bare_premise}{mask}{choice}'
COPA_CONNECTIVE_WORDS = {"cause": " because", "effect": " so"}
# Tasks that share the prompts of another.
PROMPT_ALIASES = {"ax-g": "rte", "ax-b": "rte", "mnli-mm": "mnli", "xstance-de": "xstance", "xstance-fr": "xstance", "wsc1": "wsc"}


# --- rendering -------------------------------------------------------------------------------------------------------


def _slot_sizes(parts: Sequence[Part], learned: int) -> list[int]:
    """Learned tokens per slot: ceil(n / slots) each until they run out."""
    slots = sum(1 for part in parts if part[1] == "slot")
    if not slots or not learned:
        return [0] * slots
    each = -(-learned // slots)
    return [max(0, min(each, learned - each * k)) for k in range(slots)]


def part_column(template: str, fields: dict[str, Column], learned: int = 0, prefix: int = 0) -> Column:
    """array<struct<side, kind, text, slot, shortenable>> of one pattern; slots carry their number of learned tokens."""
    parts = parts_of(template)
    sizes = iter(_slot_sizes(parts, learned))
    columns = []
    if prefix:
        columns.append(("a", "slot", F.lit(""), prefix, False))
    for side, kind, value, shortenable in parts:
        if kind == "slot":
            size = next(sizes)
            if size:
                columns.append((side, kind, F.lit(""), size, False))
        else:
            text = fields[value] if kind == "field" else F.lit(value)
            columns.append((side, "mask" if kind == "mask" else "text", text, 0, shortenable))
    return F.array(*[
        F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(size).alias("slot"), F.lit(short).alias("shortenable"))
        for side, kind, text, size, short in columns
    ])


def render(examples: DataFrame, task: str, pattern_ids: Sequence[int] | None = None, learned: int = 0, prefix: int = 0, keep: Sequence[str] = ("guid",)) -> DataFrame:
    """Every example under every wanted pattern: (keep…, pattern_id, parts)."""
    prompt = PROMPTS[PROMPT_ALIASES.get(task, task)]
    fields = prompt.fields()
    wanted = sorted(prompt.patterns) if pattern_ids is None else list(pattern_ids)

    def parts(i: int) -> Column:
        usual = part_column(prompt.patterns[i], fields, learned, prefix)
        if prompt.guard is None:
            return usual
        return F.when(prompt.guard(), part_column(PROMPTS[prompt.guarded].patterns[i], fields, learned, prefix)).otherwise(usual)

    rendered = F.array(*[F.struct(F.lit(i).alias("pattern_id"), parts(i).alias("parts")) for i in wanted])
    return examples.select(*keep, F.explode(rendered).alias("p")).select(*keep, "p.*")


def side_text(parts: Column, side: str, mask: str = "[MASK]") -> Column:
    """One side of a prompt as text."""
    chosen = F.filter(parts, lambda p: p["side"] == side)
    return F.array_join(F.transform(chosen, lambda p: F.when(p["kind"] == "mask", mask).otherwise(p["text"])), "")


def verbalizer_table(spark, task: str) -> DataFrame:
    """(task, pattern_id, label, answer) of a task."""
    words = PROMPTS[PROMPT_ALIASES.get(task, task)].words
    rows = [(task, i, label, answer) for i, by_label in sorted(words.items()) for label, answer in by_label.items()]
    return spark.createDataFrame(rows, "task string, pattern_id int, label string, answer string")


def verbalize(task: str, pattern_id: Column, label: Column) -> Column:
    """Label word of a row, as an expression over the few pattern ids and labels of the task."""
    result = F.lit(None).cast("string")
    for i, by_label in PROMPTS[PROMPT_ALIASES.get(task, task)].words.items():
        for value, answer in by_label.items():
            result = F.when((pattern_id == i) & (label == value), answer).otherwise(result)
    return result


def parse_verbalizer(lines: DataFrame, file: str, line_no: str, value: str) -> DataFrame:
    """Verbalizer file: a line of digits opens a pattern, every other line is a label and its words."""
    digits = F.col(value).rlike(r"^\d+$")
    opened = F.last(F.when(digits, F.col(value).cast("int")), ignorenulls=True).over(
        Window.partitionBy(file).orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("pattern_id", opened).filter(~digits & (F.col(value) != ""))
    words = split_words(F.col(value))
    return rows.select(file, "pattern_id", line_no, words[0].alias("label"), A.drop(words, 1).alias("words"))


def single_token_violations(verbalizers: DataFrame, vocab: DataFrame) -> DataFrame:
    """Label words that are not exactly one non-command token of the vocabulary."""
    words = vocab.filter(~F.col("is_command")).select(F.col("token").alias("word"))
    return verbalizers.withColumn("word", F.trim("answer")).join(words, "word", "left_anti").drop("word")


# --- token form ------------------------------------------------------------------------------------------------------


def encode_parts(parts: Column, encode: Callable[[Column], Column], mask: int, learned_id: int) -> Column:
    """array<struct<side, tokens, shortenable>>."""
    tokens = lambda p: F.when(p["kind"] == "mask", F.array(F.lit(mask))).when(p["kind"] == "slot", A.repeat(learned_id, p["slot"])).otherwise(encode(p["text"]))
    return F.transform(parts, lambda p: F.struct(p["side"].alias("side"), tokens(p).alias("tokens"), p["shortenable"].alias("shortenable")))


def truncate_parts(df: DataFrame, parts: str, answer_size: Column, max_length: int) -> DataFrame:
    """Shorten `parts` so that prompt, answer and special tokens fit.

    One token at a time goes from the side with more shortenable tokens (the second on a tie), off the last of its parts
    that has any. In closed form: the sides level out first and then share the rest; on a side, later parts go first. Adds
    `removed`, and `overflow` where nothing is left to shorten.
    """
    special = 2 + F.when(answer_size > 0, 0).otherwise(1)
    total = F.aggregate(F.col(parts), F.lit(0), lambda acc, p: acc + F.size(p["tokens"])) + answer_size + special
    free = lambda side: F.aggregate(F.filter(parts, lambda p: p["shortenable"] & (p["side"] == side)), F.lit(0), lambda acc, p: acc + F.size(p["tokens"]))
    df = df.withColumns({"removed": F.greatest(total - max_length, F.lit(0)), "__a": free("a"), "__b": free("b")})
    loss_a, loss_b = pair_losses(F.col("__a"), F.col("__b"), F.col("__a") + F.col("__b") - F.col("removed"))
    df = df.withColumns({"overflow": F.col("removed") > F.col("__a") + F.col("__b"), "__la": loss_a, "__lb": loss_b})

    def shorten(v: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            later = F.aggregate(F.filter(v["p"], lambda q, j: (j > i) & q["shortenable"] & (q["side"] == p["side"])), F.lit(0), lambda acc, q: acc + F.size(q["tokens"]))
            loss = F.greatest(F.when(p["side"] == "a", v["la"]).otherwise(v["lb"]) - later, F.lit(0))
            kept = F.when(p["shortenable"], A.head(p["tokens"], F.size(p["tokens"]) - loss)).otherwise(p["tokens"])
            return F.struct(p["side"].alias("side"), kept.alias("tokens"), p["shortenable"].alias("shortenable"))

        return F.transform(v["p"], one)

    shortened = A.let(F.struct(F.col(parts).alias("p"), F.col("__la").alias("la"), F.col("__lb").alias("lb")), shorten)
    return df.withColumn(parts, shortened).drop("__a", "__b", "__la", "__lb")


def side_tokens(parts: Column, side: str) -> Column:
    return F.flatten(F.transform(F.filter(parts, lambda p: p["side"] == side), lambda p: p["tokens"]))


def answer_segments(answers: DataFrame, keys: Sequence[str], answer: str, eop: int, segment_length: int = 0) -> DataFrame:
    """Cut every answer and its closing `eop` into segments; `spliced` are the tokens of the segments before."""
    whole = F.concat(answer, F.array(F.lit(eop)))
    df = answers.withColumn("__whole", whole)
    size = F.lit(segment_length) if segment_length else F.size("__whole")
    cuts = F.transform(A.counting(0, F.ceil(F.size("__whole") / size).cast("int")), lambda k: F.struct(
        k.alias("segment"), A.take(F.col("__whole"), k * size, size).alias("target"), A.head(F.col("__whole"), k * size).alias("spliced")))
    return df.select(*keys, F.explode(cuts).alias("s")).select(*keys, "s.*")


def splice_before(tokens: Column, mask: int, extra: Column) -> Column:
    """Insert tokens in front of the mask."""
    at = A.first_index(tokens, mask)
    return F.when(at >= 0, F.concat(A.head(tokens, at), extra, A.drop(tokens, at))).otherwise(tokens)


def fill_mask(tokens: Column, mask: int, answer: Column) -> Column:
    """Replace the first mask by the answer, as priming texts do."""
    at = A.first_index(tokens, mask)
    return F.when(at >= 0, F.concat(A.head(tokens, at), answer, A.drop(tokens, at + 1))).otherwise(tokens)


def mask_labels(tokens: Column, mask: int) -> Column:
    """1 at the first mask, -1 elsewhere."""
    return A.let(A.first_index(tokens, mask), lambda at: F.transform(tokens, lambda _, i: F.when(i == at, 1).otherwise(-1)))


def interactive_context(text: Column, generation_mask: str = "[gMASK]", cls: str = "[CLS]", eos: str = "<|endoftext|>") -> Column:
    """Prompt of a free generation: a mask at the end unless there is one, cls in front, eos behind unless it ends in a mask."""
    masked = F.when(F.contains(text, F.lit("MASK]")), text).otherwise(F.concat(text, F.lit(" " + generation_mask)))
    closing = F.when(masked.endswith(generation_mask), "").otherwise(eos)
    return F.concat(F.lit(cls), masked, closing)
