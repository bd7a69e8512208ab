"""Corpus projections: raw rows of one corpus to `(keys…, prompt, text)`, dropping rows the corpus does not keep.

All of them are row-local (`select`, `filter`, `explode`), so predicates and column pruning reach the scan and the same
functions run on a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_uniform
from tokenmill.functions.text import standardize_punctuation, strip, trim_field
from tokenmill.operators.special import special_tokens
from tokenmill.operators.vocab import encode_chars

Keys = Sequence[str]

# Prompt markers of the question-and-answer corpora.
QUESTION_MARK = "问题："
DESCRIPTION_MARK = "问题描述："
USER_MARK = "回答用户："
ANSWER_MARK = "回答："

# Sources dropped from the mixed corpus, and sources of which a share is kept.
DROPPED_SOURCES = ("Github", "StackExchange", "DM Mathematics", "Ubuntu IRC", "EuroParl", "YoutubeSubtitles", "Enron Emails")
KEPT_SHARES = {"PubMed Central": 0.3, "ArXiv": 0.3, "FreeLaw": 0.3}

SUMMARY_PREFIX = "Summary: "  # fixed value


def _text(name: str) -> Column:
    """An optional text field: absent and null both read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def longer_than(text: Column, limit: int) -> Column:
    return F.length(text) > limit


def in_language(lang: Column, wanted: str = "en") -> Column:
    return lang == wanted


def not_in_sources(source: Column, dropped: Sequence[str]) -> Column:
    return ~source.isin(list(dropped))


def voted_or_long(text: Column, votes: Column, min_chars: int = 100, min_votes: int = 1000) -> Column:
    """Long enough, or voted up often enough; blank votes count as none."""
    count = F.coalesce(votes.try_cast("bigint"), F.lit(0))
    return (F.length(text) > min_chars) | (count > min_votes)


def plain_text(df: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """Text as it is, no prompt."""
    return df.select(*keys, F.lit("").alias("prompt"), F.col("text"))


def non_empty_text(df: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """Non-empty text, no prompt (stories, and line-per-document corpora)."""
    return plain_text(df.filter(_text("text") != ""), keys)


def web_text(df: DataFrame, keys: Keys = ("doc_id",), min_chars: int = 100, lang: str = "en") -> DataFrame:
    """Long texts of one language; the language is an input column."""
    return plain_text(df.filter(longer_than(F.col("text"), min_chars) & in_language(F.col("lang"), lang)), keys)


def prompt_text(df: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """Prompt and text as they are."""
    return df.select(*keys, "prompt", "text")


def voted_answers(df: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """Answers that are long or well voted, prompted with question, trimmed description and signature."""
    kept = df.filter(voted_or_long(_text("ans-content"), F.col("ans-up-num")))
    prompt = F.concat(
        F.lit(QUESTION_MARK), _text("q_title"),
        F.lit(DESCRIPTION_MARK), trim_field(_text("q-content"), 100),
        F.lit(USER_MARK), _text("user-signature"),
        F.lit(" " + ANSWER_MARK),
    )
    return kept.select(*keys, prompt.alias("prompt"), _text("ans-content").alias("text"))


def best_and_other_answers(df: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """The best answer over 10 characters, then every other answer over 100, all under the same prompt."""
    prompt = F.concat(
        F.lit(QUESTION_MARK), F.col("title"),
        F.lit(DESCRIPTION_MARK), trim_field(_text("content"), 100),
        F.lit(ANSWER_MARK),
    )
    best = F.filter(F.array(F.col("best_answer.content")), lambda a: F.length(a) > 10)
    others = F.filter(
        F.transform(F.coalesce(F.col("other_answers"), F.array().cast("array<struct<content:string>>")), lambda a: a["content"]),
        lambda a: F.length(a) > 100,
    )
    return (
        df.filter(F.col("title").isNotNull())
        .select(*keys, prompt.alias("prompt"), F.posexplode(F.concat(best, others)).alias("answer_no", "text"))
    )


def encyclopedia(df: DataFrame, keys: Keys = ("doc_id",)) -> DataFrame:
    """Title, abstract and content glued together."""
    text = F.concat(_text("title"), _text("abstract"), _text("content"))
    return df.select(*keys, F.lit("").alias("prompt"), text.alias("text")).filter(F.col("text") != "")


def _leading(field: str) -> Column:
    return F.when(_text(field) != "", F.concat(strip(F.col(field)), F.lit(" "))).otherwise("")


def news(df: DataFrame, keys: Keys = ("doc_id",), min_chars: int = 100) -> DataFrame:
    """Title, then the description unless the body repeats it, then the body."""
    body, description = _text("maintext"), _text("description")
    repeats = (body != "") & body.startswith(description)
    text = F.concat(_leading("title"), F.when(~repeats, _leading("description")).otherwise(""), body)
    return df.select(*keys, F.lit("").alias("prompt"), text.alias("text")).filter(longer_than(F.col("text"), min_chars))


def titled_text(df: DataFrame, keys: Keys = ("doc_id",), min_chars: int = 100) -> DataFrame:
    """Stripped title, a space, the content."""
    text = F.concat(_leading("title"), _text("content"))
    return df.select(*keys, F.lit("").alias("prompt"), text.alias("text")).filter(longer_than(F.col("text"), min_chars))


def mixed_sources(
    df: DataFrame,
    keys: Keys = ("doc_id",),
    dropped: Sequence[str] = DROPPED_SOURCES,
    shares: dict[str, float] = KEPT_SHARES,
    seed: str | int = "mixed",
) -> DataFrame:
    """Drop some sources, keep a share of others; `source` stays for the length report."""
    share = F.lit(1.0)
    for name, value in shares.items():
        share = F.when(F.col("source") == name, F.lit(float(value))).otherwise(share)
    kept = df.filter((_text("source") != "") & (_text("text") != "") & not_in_sources(F.col("source"), dropped))
    kept = kept.filter((share == 1.0) | (hash_uniform(seed, *keys) <= share))
    return kept.select(*keys, "source", F.lit("").alias("prompt"), "text")


def key_and_content(
    df: DataFrame, encode: Callable[[Column], Column] = encode_chars, end_of_piece: int = special_tokens().eop, keys: Keys = ("doc_id",)
) -> DataFrame:
    """Two rows per article: all keys behind a summary prefix, and keys interleaved with their contents.

    `key` and `content` are parallel text arrays; `encode` turns text into token ids, by characters unless told otherwise. `runs` holds alternating lengths of
    tokens without and with loss.
    """
    spaced = F.transform(F.col("key"), lambda k, i: F.when(i == 0, k).otherwise(F.concat(F.lit(" "), k)))
    pieces = F.arrays_zip(
        F.transform(spaced, encode).alias("k"),
        F.transform(F.col("content"), lambda c: F.concat(encode(F.concat(F.lit(" "), c)), F.array(F.lit(end_of_piece)))).alias("c"),
    )
    df = df.select(*keys, pieces.alias("pieces"))
    prefix = encode(F.lit(SUMMARY_PREFIX))
    summary = F.flatten(F.transform("pieces", lambda p: p["k"]))
    rows = F.array(
        F.struct(
            F.lit("summary").alias("part"),
            F.concat(prefix, summary).alias("tokens"),
            F.array(F.size(prefix), F.size(summary)).alias("runs"),
        ),
        F.struct(
            F.lit("content").alias("part"),
            F.flatten(F.transform("pieces", lambda p: F.concat(p["k"], p["c"]))).alias("tokens"),
            F.flatten(F.transform("pieces", lambda p: F.array(F.size(p["k"]), F.size(p["c"])))).alias("runs"),
        ),
    )
    return df.select(*keys, F.explode(rows).alias("row")).select(*keys, "row.*")


def standardized(df: DataFrame) -> DataFrame:
    """Punctuation standardization, for corpora that do not reserve their punctuation."""
    return df.withColumns({"prompt": standardize_punctuation(F.col("prompt")), "text": standardize_punctuation(F.col("text"))})


# Corpus registry: a new corpus is one more function here. Corpora that reserve punctuation keep their curly quotes.
CORPORA: dict[str, Callable[..., DataFrame]] = {
    "wikipedia": plain_text,
    "wikipedia-key": key_and_content,
    "openwebtext": web_text,
    "zhihu": voted_answers,
    "zhidao": best_and_other_answers,
    "baike": encyclopedia,
    "test": prompt_text,
    "wikibook": non_empty_text,
    "bert-base": non_empty_text,
    "bert-large": non_empty_text,
    "cc-news": news,
    "pile": mixed_sources,
    "stories": non_empty_text,
    "wudao": titled_text,
}
RESERVE_PUNCTUATION = frozenset({"zhihu", "zhidao", "baike", "wudao"})


def prepare(name: str, df: DataFrame, keys: Keys = ("doc_id",), **options) -> DataFrame:
    """A corpus of the registry, with standard punctuation unless it reserves its own; fields that become ids are standardized first."""
    if name in RESERVE_PUNCTUATION:
        return CORPORA[name](df, keys=keys, **options)
    if name == "wikipedia-key":
        each = lambda c: F.transform(F.col(c), standardize_punctuation)
        return CORPORA[name](df.withColumns({"key": each("key"), "content": each("content")}), keys=keys, **options)
    return standardized(CORPORA[name](df, keys=keys, **options))


def concat_corpora(parts: dict[str, DataFrame]) -> DataFrame:
    """Bag union of prepared corpora, tagged with the corpus name."""
    tagged = [df.withColumn("corpus", F.lit(name)) for name, df in parts.items()]
    result = tagged[0]
    for df in tagged[1:]:
        result = result.unionByName(df)
    return result


def source_totals(df: DataFrame, length: Column) -> DataFrame:
    """Emitted rows and length per source; map-side combined, so a dominant source costs one row per task."""
    return df.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(length).cast("bigint").alias("total_length"))


def with_hook(df: DataFrame, hook: Callable[[Column], Column], column: str = "text") -> DataFrame:
    """Apply a caller's text rule; a column expression, so the plan stays inside the JVM."""
    return df.withColumn(column, hook(F.col(column)))
