"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

Subwords are the 3- and 4-byte pieces of words with their edges marked, hashed into buckets. A text is the mean of its buckets'
vectors. Training is a fit on a bounded sample: at most about SAMPLE_ROWS rows, spread evenly over all
languages and chosen by a hash of the row, and one of each language at least, which does not calibrate; a row reaches the driver as its bucket counts, so the bound in bytes is rows x
buckets x 6. A fifth of the sample calibrates: a temperature that minimizes the loss, then a rejection threshold for each language. It comes
from the scores of the rows that are rightly predicted to be of the language, so that neither wrong labels nor languages that can't be
learned raise it: the score that the share MOST of them stay below, or the one SPREADS standard deviations of their log-odds below the mean
where that is less (a few rows don't show their tail), and at most FLOOR times an even spread over the languages (over FLOOR_LANGUAGES of
more). So about MOST of a language's rightly predicted rows are rejected at most, however the corpus spreads over the languages. A
language with less than LEAST_ROWS such rows has FLOOR times an even spread at most. Prediction runs over all documents and whole texts.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; so is everything if no language
could be learned; equal scores go to the language first in order; repeated rows repeat; only the columns asked for are carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import list_array, pieces, released, stored, utf8

BUCKETS = 1 << 14
DIM = 16
SAMPLE_ROWS = 4_000
MOST, SPREADS = 0.01, 3.0
FLOOR, FLOOR_LANGUAGES = 1.5, 4
LEAST_ROWS = 8
EPOCHS, BATCH, RATE = 8, 32, 8.0
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def bucket_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """How many subwords of each bucket the texts hold, row by row."""
    data, offsets = utf8(column)
    for first, last in pieces(offsets):
        at, rows = offsets[first:last + 1] - offsets[first], last - first
        sizes = np.diff(at)
        text = np.full(at[-1] + rows + 1, 32, np.uint32)  # a space before, between and after
        text[np.arange(at[-1]) + np.repeat(np.arange(rows), sizes) + 1] = _FOLD[data[offsets[first]:offsets[last]]]
        letter = text != 32
        starts = at + np.arange(rows + 1)
        found, places = [], []
        for n, odd in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
            code = np.zeros(max(0, len(text) - n + 1), np.uint32)
            for k in range(n):
                code = code << np.uint32(8) | text[k:k + len(code)]
            inside = letter[1:1 + len(code)] if n == 3 else letter[1:1 + len(code)] & letter[2:2 + len(code)]
            place = np.flatnonzero(inside)
            found.append((code[place] * np.uint32(odd)) >> np.uint32(32 - 14))
            places.append(np.searchsorted(place, starts))
        for r in range(rows):
            yield sum(np.bincount(f[p[r]:p[r + 1]], minlength=BUCKETS) for f, p in zip(found, places))


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # of the languages' scores
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return mean @ self.embeddings @ self.weights

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = (logits - logits.max(axis=1, keepdims=True)) / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def crc_part(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, eligible: Column) -> tuple[list[str], list[tuple[int, bool, np.ndarray, np.ndarray]]]:
    """Languages, and of the chosen rows: language, whether it calibrates, buckets, counts."""
    rows = docs.where(eligible & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")), "language-sizes")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not languages:
        return [], []
    uniform = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    least = F.col("h") == F.col("least")
    chosen = rows.join(F.broadcast(sizes), "lang").where((uniform < SAMPLE_ROWS // len(languages) / F.col("n")) | least)
    chosen = chosen.dropDuplicates(["lang", "h"]).select("lang", ((F.pmod("h", F.lit(5)) == 0) & ~least).alias("test"), "t", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, held = [], []
            for row in bucket_counts(batch.column("t")):
                some.append(np.flatnonzero(row))
                held.append(row[some[-1]])
            sizes = np.array([len(s) for s in some], np.int64)
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (some, held)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("test"), batch.column("h"), list_array(flat[0].astype(np.int16), sizes, pa.int16()), list_array(flat[1].astype(np.float32), sizes, pa.float32())], ["lang", "test", "h", "buckets", "counts"])

    table = chosen.mapInArrow(released(run), "lang string, test boolean, h long, buckets array<smallint>, counts array<float>").toArrow()
    table = table.sort_by([("h", "ascending"), ("lang", "ascending")])
    number = {lang: k for k, lang in enumerate(languages)}
    cells = zip(*(table.column(c) for c in ("lang", "test", "buckets", "counts")))
    return languages, [(number[lang.as_py()], test.as_py(), np.asarray(b.values), np.asarray(c.values)) for lang, test, b, c in cells]


def _dense(rows: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (_, _, buckets, counts) in enumerate(rows):
        out[k, buckets] = counts / counts.sum()
    return out


def train(docs: DataFrame, eligible: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 7) -> Model:
    """A model of the languages of `lang_col`, from rows that are eligible and have a language and a letter."""
    languages, rows = _sample(docs, id_col, text_col, lang_col, F.lit(True) if eligible is None else eligible)
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), rng.uniform(-1, 1, (DIM, max(1, len(languages)))).astype(np.float32), np.zeros(max(1, len(languages))))
    fit, test = ([r for r in rows if r[1] == flag] for flag in (False, True))
    fit, test = fit or test, test or fit
    steps = EPOCHS * -(-len(fit) // BATCH)
    step = 0
    for _ in range(EPOCHS if fit else 0):
        order = rng.permutation(len(fit))
        for start in range(0, len(fit), BATCH):
            batch = [fit[k] for k in order[start:start + BATCH]]
            x, y = _dense(batch), np.array([r[0] for r in batch])
            hidden = x @ model.embeddings
            p = model.scores(hidden @ model.weights)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            rate = RATE * (1 - step / steps)
            back = p @ model.weights.T
            model.weights -= np.float32(rate / 4) * (hidden.T @ p)
            model.embeddings -= np.float32(rate * 8) * (x.T @ back)
            step += 1
    if test:
        logits = np.concatenate([_dense(test[k:k + 256]) @ model.embeddings @ model.weights for k in range(0, len(test), 256)])
        y = np.array([r[0] for r in test])

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.scores(logits)[np.arange(len(y)), y], 1e-12)).mean())

        model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
        scores = model.scores(logits)
        top, right = scores.max(axis=1), scores.argmax(axis=1) == y
        model.thresholds = np.full(len(languages), min(0.99, FLOOR / len(languages)))
        floor = min(0.99, FLOOR / min(len(languages), FLOOR_LANGUAGES))
        for k in np.unique(y[right]):
            own = np.sort(top[right & (y == k)].astype(np.float64))
            odds = np.log(np.maximum(own, 1e-6) / np.maximum(1 - own, 1e-6))
            low = 1 / (1 + np.exp(SPREADS * odds.std() - odds.mean()))
            level = floor if len(own) >= LEAST_ROWS else model.thresholds[k]
            model.thresholds[k] = min(level, low, own[int(MOST * len(own))])
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all by default), then lang_pred, score and rejected, which replace columns of those names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    head = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            letters = np.asarray(batch.column("letter")).astype(bool)
            best, score, block = np.zeros(len(letters), np.int64), np.zeros(len(letters)), []

            def flush(end: int) -> None:
                if block and model.languages:
                    p = model.scores(model.logits(np.array(block, np.float32)))
                    best[end - len(block):end], score[end - len(block):end] = p.argmax(axis=1), p.max(axis=1)
                block.clear()

            for k, counts in enumerate(bucket_counts(batch.column("t"))):
                block.append(counts)
                if len(block) == 64:
                    flush(k + 1)
            flush(len(letters))
            known = letters & bool(model.languages)
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.minimum(score, 1.0), 0.0)
            rejected = ~known | (score < model.thresholds[best])
            out = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*out, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter")
    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"), letter)
    out = out.mapInArrow(released(run), f"{head}{', ' if head else ''}lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_part("doc_id") == 1
    model = train(docs, ~held_out)
    return predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
