"""URL filters: rules by host and path, then the likelihood ratio of two character language models.

Urls that a rule allows or blocks are the accepted and rejected examples. For each side a Markov model of variable order counts the
characters after every context of up to ORDER characters; a probability mixes the orders from the shortest context to the longest seen
one (Witten-Bell: a context with n characters of t kinds gives its own estimate the weight n / (n + t)). A url's score is the difference of the
two log-likelihoods, divided by its length.

The counts are of all urls that a rule judges, and stay in Spark: a character's probability depends on its window, the up to ORDER characters
before it and itself. The distinct windows of the urls to score are joined with the counts, order by order, and come back to blocks of
about BLOCK_URLS urls, where a frequent window is one row for each block. The threshold is fitted on the scores of judged urls too: a fifth of the distinct
ones, by their hash and however many they are, is scored by the counts of all other urls, each weighs as many as its rows, and the threshold is the one at which the shares of
accepted and of rejected ones that are judged rightly add up to most, the smallest of equals. Up to SAMPLE_ROWS scores go to the driver; more are sorted and summed in Spark,
with the same threshold.

Defined results: null urls and urls without :// have an empty host and path, and no rule; an empty url scores 0; without examples of both
sides every url without a rule is allowed; repeated rows repeat; columns other than id and url are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import stored
from tokenmill.operators.prefix import running_total

ORDER = 5
SAMPLE_ROWS = 20_000  # scores that the driver fits the threshold on; Spark fits it on more
BLOCK_URLS = 256
ALPHABET = 1 << 16  # characters that the shortest context spreads its rest over


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def split_urls(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    lower = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": lower, "path": F.regexp_extract(url, parts, 2)})


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds rule and ruled (its verdict) of the longest rule that fits, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        name, verdict = F.when(rule.fits(), F.lit(rule.name)).otherwise(name), F.when(rule.fits(), F.lit(rule.verdict)).otherwise(verdict)
    return df.withColumns({"rule": name, "ruled": verdict})


START, STOP = "\x02", "\x03"
COUNTS = ("allow", "block", "allow_fit", "block_fit")  # of all judged urls, and of those that don't test the threshold


def windows(url: str, order: int = ORDER) -> list[str]:
    """Of every character from the first through the end mark: itself after the characters before it."""
    text = START + url + STOP
    return [text[max(0, at - order):at + 1] for at in range(1, len(text))]


def _windows(order: int) -> Column:
    """`windows` of the column u."""
    marked = F.concat(F.lit(START), F.col("u"), F.lit(STOP))
    return F.transform(F.sequence(F.lit(2), F.length("u") + 2), lambda at: F.substring(marked, F.greatest(at - order, F.lit(1)), F.least(at, F.lit(order + 1))))


def _suffixes(window: str) -> Column:
    size = F.length(window)
    return F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(F.col(window), size - k + 1, k))


def count_grams(urls: DataFrame, order: int) -> DataFrame:
    """gram and COUNTS, of urls (u, ruled, n, test); windows are counted first, then their suffixes."""
    side = {x: (F.col("ruled") == x.removesuffix("_fit")) & (~F.col("test") if x.endswith("_fit") else F.lit(True)) for x in COUNTS}
    whole = urls.select(F.explode(_windows(order)).alias("w"), *[F.when(own, F.col("n")).otherwise(0).alias(x) for x, own in side.items()])
    whole = whole.groupBy("w").agg(*[F.sum(x).alias(x) for x in COUNTS])
    return whole.select(F.explode(_suffixes("w")).alias("gram"), *COUNTS).groupBy("gram").agg(*[F.sum(x).alias(x) for x in COUNTS])


def probabilities(wanted: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """gram and the probability of its last character after the others, by each of COUNTS; for the windows w and all of their suffixes."""
    context = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1)
    contexts = counts.groupBy(context.alias("context")).agg(*[F.sum(x).alias(f"n_{x}") for x in COUNTS], *[F.count_if(F.col(x) > 0).alias(f"kinds_{x}") for x in COUNTS])
    grams = wanted.select("w").distinct().select(F.explode(_suffixes("w")).alias("gram")).distinct()
    grams = stored(grams.join(counts, "gram", "left").withColumn("context", context).join(contexts, "context", "left"), "url-grams")
    levels = []
    for k in range(order + 1):  # a gram has its estimate from the one without its first character; few share that one
        level = grams.where(F.length("gram") == k + 1)
        if k:
            level = level.withColumn("rest", F.substring("gram", 2, k)).join(levels[-1].select(F.col("gram").alias("rest"), *[F.col(x).alias(f"p_{x}") for x in COUNTS]), "rest")
        else:
            level = level.withColumns({f"p_{x}": F.lit(1.0 / ALPHABET) for x in COUNTS})
        own = {x: (F.coalesce(x, F.lit(0)) + F.col(f"kinds_{x}") * F.col(f"p_{x}")) / (F.col(f"n_{x}") + F.col(f"kinds_{x}")) for x in COUNTS}
        levels.append(stored(level.select("gram", *[F.when(F.col(f"n_{x}") > 0, p).otherwise(F.col(f"p_{x}")).alias(x) for x, p in own.items()]), "url-level"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def score_urls(urls: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """u, ruled, n and score (above 0: more like accepted urls) of distinct urls; those with a verdict are scored without the test urls."""
    blocks = max(1, -(-urls.count() // BLOCK_URLS))
    urls = urls.select("u", "ruled", "n", F.pmod(F.xxhash64(F.lit(1), "u"), F.lit(blocks)).alias("part"))
    wanted = stored(urls.repartition("part").select("part", F.explode(_windows(order)).alias("w")).distinct(), "url-windows")
    found = wanted.join(probabilities(wanted, counts, order).withColumnRenamed("gram", "w"), "w")

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        logs = {w: [math.log(x) for x in p] for w, *p in zip(*(found.column(c).to_pylist() for c in ("w", *COUNTS)))}
        scores = []
        for url, ruled in zip(rows.column("u").to_pylist(), rows.column("ruled").to_pylist()):
            side = COUNTS.index("allow" if ruled is None else "allow_fit")
            own = [logs[w] for w in windows(url, order)]
            scores.append((sum(p[side] for p in own) - sum(p[side + 1] for p in own)) / len(url))
        return pa.table({"u": rows.column("u"), "ruled": rows.column("ruled"), "n": rows.column("n"), "score": pa.array(scores, pa.float64())})

    return urls.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, "u string, ruled string, n long, score double")


def best_threshold(tested: list[tuple[float, bool, int]]) -> float:
    """Of (score, accepted, rows): where the shares of accepted and of rejected rows that are judged rightly add up to most."""
    tested = sorted(tested)
    good, bad = (sum(n for _, a, n in tested if a == side) for side in (True, False))
    threshold = -math.inf
    if good and bad:
        best, gain = 0, 0  # nothing is blocked; the sum of both shares, times good * bad, grows with each rejected row below
        for k, (score, accepted, n) in enumerate(tested):
            gain += -n * bad if accepted else n * good
            if (k + 1 == len(tested) or tested[k + 1][0] > score) and gain > best:
                best, threshold = gain, math.nextafter(score, math.inf)
    return threshold


def fit_threshold(tested: DataFrame) -> float:
    """`best_threshold` of urls (score, ruled, n), however many they are."""
    if tested.count() <= SAMPLE_ROWS:
        return best_threshold([(r["score"], r["ruled"] == "allow", r["n"]) for r in tested.select("score", "ruled", "n").collect()])
    own = [F.coalesce(F.sum(F.when(F.col("ruled") == side, F.col("n"))), F.lit(0)) for side in ("allow", "block")]
    good, bad = tested.agg(own[0].alias("good"), own[1].alias("bad")).first()
    if not good or not bad:
        return -math.inf
    exact = lambda n: F.lit(n).cast("decimal(19,0)")
    step = F.sum(F.when(F.col("ruled") == "allow", -F.col("n").cast("decimal(18,0)") * exact(bad)).otherwise(F.col("n").cast("decimal(18,0)") * exact(good)))
    gains = running_total(tested.groupBy("score").agg(step.cast("decimal(38,0)").alias("step")), "score", F.col("step"), "gain", kind="decimal(38,0)")
    gains = gains.select("score", (F.col("gain") + F.col("step")).cast("decimal(38,0)").alias("gain"))
    best = gains.agg(F.max(F.struct("gain", (-F.col("score")).alias("minus"))).alias("best")).first()["best"]
    return math.nextafter(-best["minus"], math.inf) if best["gain"] > 0 else -math.inf


def learn(judged: DataFrame, order: int = ORDER) -> tuple[DataFrame, float] | None:
    """Scores (u, score) of the distinct urls without a rule, and the threshold; None where a side has no examples."""
    urls = stored(judged.where(F.length("u") > 0).groupBy("u", "ruled").agg(F.count("*").alias("n")), "url-distinct")
    if urls.where("ruled is not null").select("ruled").distinct().count() < 2:
        return None
    urls = urls.withColumn("test", F.col("ruled").isNotNull() & (F.pmod(F.xxhash64("u"), F.lit(5)) == 0))
    counts = stored(count_grams(urls.where("ruled is not null"), order), "url-counts")
    scores = stored(score_urls(urls.where("ruled is null or test"), counts, order), "url-scores")
    return scores.where("ruled is null").select("u", "score"), fit_threshold(scores.where("ruled is not null"))


def filter_urls(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, score (null where a rule decides) and verdict."""
    judged = apply_rules(split_urls(df.select(F.col(id_col).alias("id"), F.col(url_col).alias("u")), "u"), rules)
    learned = learn(judged)
    scored = F.col("ruled").isNull() & (F.coalesce(F.length("u"), F.lit(0)) > 0) if learned else F.lit(False)
    out = judged.where(~scored).withColumn("score", F.when(F.col("ruled").isNull(), F.lit(0.0)))
    if learned:
        out = out.unionByName(judged.where(scored).join(learned[0], "u", "left"))
    model = F.when(F.col("score") < (learned[1] if learned else -math.inf), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "score", F.coalesce("ruled", model).alias("verdict"))


def op10(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
