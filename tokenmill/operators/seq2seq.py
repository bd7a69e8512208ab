"""Source sides of generation tasks: prompt, question and text in one token array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions.text import repair_span_answer, strip
from tokenmill.operators.sequences import around_answer
from tokenmill.operators.special import Special

SUMMARY_TASKS = ("gigaword", "cnn_dm", "cnn_dm_original", "xsum")


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def source_tokens(task: str, encode: Callable[[Column], Column], special: Special, length: int, period: int = ord(".")) -> Column:
    """Source of at most `length` tokens from `text_a` and the question or answer in `meta`."""
    one = lambda x: F.array(F.lit(x))
    text = F.col("text_a")
    if task in SUMMARY_TASKS:
        prompt = F.concat(one(special.cls), one(special.mask), encode(F.lit(" Content:")))
        return A.head(F.concat(prompt, encode(F.concat(F.lit(" "), text))), length)
    if task == "squad_generation":
        answer = encode(F.concat(F.lit(" Answer: "), F.col("meta.answer")))
        pattern = encode(F.concat(F.lit(" "), F.col("meta.answer")))
        source = around_answer(encode(F.concat(_rstrip(text), F.lit(" Question:"))), pattern, F.lit(length - 2) - F.size(answer))
        return F.concat(one(special.cls), source, one(special.mask), answer)
    if task in ("squad", "squad_v1"):
        question = encode(F.concat(F.lit(" "), strip(F.col("meta.question"))))
        source = encode(F.concat(F.lit(" "), _rstrip(text)))
        return F.concat(one(special.cls), question, one(special.mask), one(period), A.head(source, F.lit(length - 3) - F.size(question)))
    if task == "cmrc":
        question = encode(F.concat(F.lit("问题："), strip(F.col("meta.question")), F.lit("答案：")))
        # A question that fills the source alone is cut to a quarter of it, so that some text remains.
        question = F.when(F.size(question) >= length - 2, A.head(question, length // 4)).otherwise(question)
        return F.concat(one(special.cls), question, one(special.mask), A.head(encode(_rstrip(text)), F.lit(length - 2) - F.size(question)))
    raise ValueError(f"no source layout for {task}")


def span_text(context: Column, tokens: Column, offsets: Column, predicted: Column, decoded: Column) -> Column:
    """Text of a predicted token run in its context: the characters under its first occurrence.

    `offsets` are (start, end) characters per token. A not-answerable mark is kept, and a run that does not occur falls back
    to the decoded text with its spacing repaired.
    """
    at = F.get(A.sublist_positions(tokens, predicted), F.lit(0))
    start, end = F.get(offsets, at)["start"], F.get(offsets, at + F.size(predicted) - 1)["end"]
    found = context.substr(start + 1, end - start)
    blank = F.lower(F.replace(decoded, F.lit(" "), F.lit(""))) == "n/a"
    return F.when(blank, decoded).when(at.isNotNull(), found).otherwise(repair_span_answer(decoded))
