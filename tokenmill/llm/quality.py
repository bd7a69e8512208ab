"""Quality rules: a table of thresholds compiled into one projection over text statistics, built-in functions only.

Defined results: a null or empty text has no words, so it fails the length rule; a ratio with denominator zero counts as zero;
repeated input rows give repeated output rows; columns other than id, text and language are ignored, so their names cannot clash. The rule on
stop words holds for the languages that STOP_WORDS has; a text of another or of no language, or of a table without that column, is not judged by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "that", "with", "is", "for"),
    "de": ("der", "die", "das", "und", "den", "zu", "von", "mit", "ist"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "est", "dans"),
    "es": ("el", "los", "las", "del", "que", "en", "por", "con", "se"),
}


@dataclass(frozen=True)
class Rule:
    """`statistic` per `per` (or by itself) in thousandths, at least `low` and at most `high`; only where `only` holds, if it is given."""

    name: str
    statistic: str
    per: str | None = None
    low: int | None = None
    high: int | None = None
    only: str | None = None

    def broken(self) -> Column:
        value, unit = F.col(self.statistic) * 1000, F.col(self.per) if self.per else F.lit(1)
        tests = [value < self.low * unit] if self.low is not None else []
        tests += [value > self.high * unit] if self.high is not None else []
        test = tests[0]
        for other in tests[1:]:
            test = test | other
        return test & F.col(self.only) if self.only else test

    def sql(self) -> str:
        unit = self.per or "1"
        tests = [f"{self.statistic} * 1000 < {self.low} * {unit}"] if self.low is not None else []
        tests += [f"{self.statistic} * 1000 > {self.high} * {unit}"] if self.high is not None else []
        return "(" + " OR ".join(tests) + ")" + (f" AND {self.only}" if self.only else "")


THRESHOLDS = (
    Rule("length", "n_words", low=50_000),
    Rule("repetition", "n_repeat_words", "n_words", high=500),
    Rule("word_length", "word_chars", "n_words", low=2_000, high=15_000),
    Rule("symbols", "n_symbols", "n_words", high=250),
    Rule("stop_words", "n_stop_words", "n_words", low=20, only="known_language"),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
)


def _same(a: Column, b: Column) -> Column:
    return (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", stop_words: dict[str, tuple[str, ...]] = STOP_WORDS) -> DataFrame:
    """Counts of every whole text.

    Windows of three words lie sorted by their words and place, so equal ones are neighbours and nothing is hashed; the words of
    repeated windows are then counted from their sorted places.
    """
    stops = [form for own in stop_words.values() for w in own for form in (w, w.capitalize())]
    known = F.coalesce(F.col(lang_col).isin(*stop_words), F.lit(False)) if lang_col in df.columns else F.lit(False)
    df = df.select(F.col(id_col).alias("id"), known.alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.select("id", "known", "t", F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    window = lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c"), i.alias("i"))
    df = df.select(
        "id", F.col("known").alias("known_language"), F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("w", lambda x: x.isin(stops))).cast("bigint").alias("n_stop_words"),
        F.when(F.size("w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), window))).alias("s"))
    again = lambda x, j: F.coalesce(_same(x, F.get("s", j - 1)), F.lit(False)) | F.coalesce(_same(x, F.get("s", j + 1)), F.lit(False))
    df = df.withColumn("p", F.sort_array(F.transform(F.filter("s", again), lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("p", start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("s", "p").withColumnRenamed("id", id_col)


def judge(stats: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Adds `failed` (names of the broken rules, comma-joined, in table order) and `kept`, in one projection."""
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    return stats.withColumns({"failed": F.array_join(names, ","), "kept": F.size(names) == 0})


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """One row per input row: the statistics, the broken rules and the verdict."""
    return judge(statistics(df, id_col, text_col, lang_col), rules)


def op6(spark, sf_dir: str) -> DataFrame:
    df = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("kept")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "failed", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for own in STOP_WORDS.values() for s in own for w in (s, s.capitalize()))
OP6_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang IN ({', '.join(map(repr, STOP_WORDS))}), false) AS known_language, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
p AS (SELECT r, len(w) AS n, unnest(list_transform(range(len(w) - 2), lambda i: {{'i': i, 'a': w[i + 1], 'b': w[i + 2], 'c': w[i + 3]}})) AS s FROM w WHERE len(w) >= 3),
g AS (SELECT r, s.i AS i, count(*) OVER (PARTITION BY r, s.a, s.b, s.c) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS d(k) WHERE n > 1 GROUP BY r),
s AS (SELECT doc_id, known_language, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(w, lambda x: x IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
j AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in THRESHOLDS)}) AS failed,
             n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, failed, base_failed, NOT base_failed AND failed = '' AS kept FROM j
"""
