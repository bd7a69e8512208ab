"""Benchmark decontamination as a prefix-filtered set join.

A window is `width` consecutive words of an item (the whole item if it has fewer). Exact containment of a window needs all of its
shingles, so the prefix that a join has to look at is its one rarest shingle: all documents are counted first, and every window is
entered under the shingle that they hold least often. Documents are then joined with these entries. A hit fixes where the item would
have to lie, the bounds of both texts cut that place short, and words are compared outwards from the shingle: a common run of
the item's window size or more is a contained window, a shorter one is not.

The benchmark is the stated query set: it is cut into blocks of a bounded number of words, and every block is sent to all documents in a
pass of its own; the driver holds one block at a time. Nothing about the documents is collected but the counts of a block's own shingles.
A pass writes what it found, by 128 bits of hashes of the text, and no texts. At the end a bitmap of these hashes tells most documents that
they have no hits; the others are joined with theirs.

Defined results: null and empty texts have no words; items without words are left out; items without an id are searched like others, but
have no id to report; an id that occurs twice counts once; repeated document rows give repeated results; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import Words, may_hold, pieces, released, stored, utf8

WIDTH = 10
SHINGLE = 3
SLICE_WORDS = 4096  # of an item, plus the overlap that keeps every window whole
BLOCK_WORDS = 200_000  # of the benchmark, sent to the executors at once
WORD_BYTES = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Words in Spark, as the patterns of this module have them."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1)


class Block:
    """Slices of items with their words as numbers; entries: for shingles of 1, 2 and 3 words, code -> places (slice, place in it)."""

    def __init__(self, rows: list[tuple[str | None, list[str]]], width: int):
        self.items = [item for item, _ in rows]
        vocabulary = sorted({w for _, words in rows for w in words})
        self.number = {w: k for k, w in enumerate(vocabulary)}
        data, offsets = utf8(pa.array(vocabulary, pa.string()))
        hashes = Words(WORD_BYTES)(data, offsets)[0]
        order = np.argsort(hashes)
        self.hashes, self.of_hash = hashes[order], order
        self.words = [[self.number[w] for w in words] for _, words in rows]
        self.least = [min(width, len(words)) for _, words in rows]
        self.size = [min(SHINGLE, k) for k in self.least]
        self.codes = {s: np.unique(np.concatenate([self.coded(np.array(w), s) for w, k in zip(self.words, self.size) if k == s] or [np.zeros(0, np.int64)])) for s in range(1, SHINGLE + 1)}
        self.entries: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}

    def coded(self, words: np.ndarray, size: int) -> np.ndarray:
        """One exact number for each shingle; those with a word that the block lacks are negative."""
        n, base = len(words) - size + 1, len(self.number) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(size):
            part = words[k:k + n]
            code, bad = code * base + part, bad | (part < 0)
        return np.where(bad, -1, code)

    def shingles(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size that the block has: the rows and codes of the shingles made of its words, found by the words' hashes."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        words = np.where(self.hashes[at] == hashes, self.of_hash[at], -1) if len(self.hashes) else np.full(len(hashes), -1)
        row = np.repeat(np.arange(len(counts)), counts)
        for s, keys in self.codes.items():
            if len(keys):
                codes = self.coded(words, s)
                some = np.flatnonzero(codes >= 0)
                some = some[row[some] == row[some + s - 1]]
                yield s, row[some], codes[some]

    def suspects(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Flags of the rows that hold an entry's shingle; words are compared only there."""
        flags = np.zeros(len(counts), bool)
        for s, row, codes in self.shingles(hashes, counts):
            keys = self.entries[s][0]
            flags[row[keys[np.minimum(np.searchsorted(keys, codes), len(keys) - 1)] == codes]] = True
        return flags

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in re.findall(WORD, text.translate(LOWER))] if text else [], np.int64)

    def enter(self, counts: dict[tuple[int, int], int]) -> None:
        """Every window goes under its rarest shingle, the first of equals."""
        for s in range(1, SHINGLE + 1):
            places: dict[int, set[tuple[int, int]]] = defaultdict(set)
            for k, (words, least) in enumerate(zip(self.words, self.least)):
                if self.size[k] == s:
                    codes = self.coded(np.array(words), s).tolist()
                    rarity = [(counts.get((s, c), 0), c) for c in codes]
                    for start in range(len(words) - least + 1):
                        at = min(range(start, start + least - s + 1), key=rarity.__getitem__)
                        places[codes[at]].add((k, at))
            self.entries[s] = (np.array(sorted(places), np.int64), {c: sorted(p) for c, p in places.items()})

    def match(self, words: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Starts and ends of the common runs that hold a window, and the items of those."""
        runs, items, row, seen = [], set(), words.tolist(), {}
        for s, (keys, places) in self.entries.items():
            if not len(keys) or len(words) < s:
                continue
            codes = self.coded(words, s)
            candidates = np.flatnonzero(codes >= 0)
            found = keys[np.minimum(np.searchsorted(keys, codes[candidates]), len(keys) - 1)] == codes[candidates]
            for at in candidates[found].tolist():
                for k, place in places[int(codes[at])]:
                    if at < seen.get((k, at - place), 0):
                        continue  # inside a run that is known
                    item = self.words[k]
                    if min(at, place) + min(len(row) - at, len(item) - place) < self.least[k]:
                        continue  # the texts end too soon on this diagonal
                    low, high = 0, s
                    while low < min(at, place) and row[at - low - 1] == item[place - low - 1]:
                        low += 1
                    while at + high < len(row) and place + high < len(item) and row[at + high] == item[place + high]:
                        high += 1
                    seen[k, at - place] = at + high
                    if low + high >= self.least[k]:
                        runs.append((at - low, at + high))
                        items |= {self.items[k]} - {None}
        return np.array(sorted(runs), np.int64).reshape(-1, 2), sorted(items)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Distinct slices of items, a block of bounded size at a time."""
    step = lambda i: F.struct(F.slice("w", (i * SLICE_WORDS + 1).cast("int"), SLICE_WORDS + width - 1).alias("w"), i.alias("i"))
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.floor(F.greatest(F.size("w") - width, F.lit(0)) / SLICE_WORDS).cast("int")
    rows = rows.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), step)).alias("s")).select("item", "s.w").distinct()
    rows = stored(rows.withColumn("h", F.xxhash64("item", "w")), "benchmark")
    total = rows.agg(F.sum(F.size("w"))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        yield sorted(((r["item"], r["w"]) for r in rows.where(F.pmod("h", F.lit(blocks)) == k).collect()), key=lambda r: (r[0] is not None, r))


def count_shingles(docs: DataFrame, text_col: str, block: Block) -> dict[tuple[int, int], int]:
    """How often all documents hold each shingle of the block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        totals, split = {s: np.zeros(len(c) + 1, np.int64) for s, c in b.codes.items()}, Words(WORD_BYTES)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for first, last in pieces(offsets):
                words = split(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                for s, _, codes in b.shingles(*words):
                    keys = b.codes[s]
                    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
                    totals[s] += np.bincount(at[keys[at] == codes], minlength=len(keys) + 1)
        for s, keys in b.codes.items():
            some = np.flatnonzero(totals[s][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s, np.int32)), pa.array(keys[some], pa.int64()), pa.array(totals[s][some], pa.int64())], ["s", "code", "n"])

    counts = docs.select(text_col).mapInArrow(released(run), "s int, code long, n long").groupBy("s", "code").agg(F.sum("n").alias("n"))
    return {(r["s"], r["code"]): r["n"] for r in counts.collect()}


def covered(hits: list[int]) -> int:
    """Words inside at least one run; starts and ends take turns."""
    n = end = 0
    for low, high in sorted(zip(hits[::2], hits[1::2])):
        n, end = n + max(0, high - max(low, end)), max(end, high)
    return n


def search(texts: DataFrame, block: Block) -> DataFrame:
    """(k1, k2, hits, items): starts and ends of contained windows and their items, for the texts that have some."""
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, split = sent.value, Words(WORD_BYTES)
        for batch in batches:
            column, k1, k2, out, seen = batch.column("t"), np.asarray(batch.column("k1")), np.asarray(batch.column("k2")), [], set()
            data, offsets = utf8(column)
            for first, last in pieces(offsets):
                hashes, counts = split(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                for k in (first + np.flatnonzero(b.suspects(hashes, counts))).tolist():
                    key = int(k1[k]), int(k2[k])
                    if key not in seen:
                        seen.add(key)
                        runs, found = b.match(b.numbers(column[k].as_py()))
                        if len(runs):
                            out.append((*key, runs.ravel().tolist(), found))
            columns = [list(c) for c in zip(*out)] if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["k1", "k2", "hits", "items"])

    return texts.mapInArrow(released(run), "k1 long, k2 long, hits array<long>, items array<string>").dropDuplicates(["k1", "k2"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words covered by the hits of all blocks."""
    for batch in batches:
        n_hit = [covered(h) for h in batch.column("hits").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n_hit, pa.int64()), batch.column("items")], ["k1", "k2", "n_hit", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """Per document: the columns of `keep`, the id, n_words, n_hit (words inside contained windows) and items (their ids as text, sorted)."""
    keep = list(dict.fromkeys([*(keep or []), id_col]))
    head = [f"c{i}" for i in range(len(keep))]
    text = F.col(text_col)
    rows = docs.select(*[F.col(c).alias(name) for c, name in zip(keep, head)], text.alias("t"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"))
    texts = rows.select("t", "k1", "k2")

    found = []
    for own in benchmark_blocks(benchmark, item_col, item_text_col, width):
        block = Block(own, width)
        block.enter(count_shingles(texts, "t", block))
        found.append(stored(search(texts, block), "contamination-hits"))
    none = docs.sparkSession.createDataFrame([], "k1 long, k2 long, hits array<long>, items array<string>")
    hits = reduce(DataFrame.unionByName, found, none).groupBy("k1", "k2").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = stored(hits.mapInArrow(_merged, "k1 long, k2 long, n_hit long, items array<string>"), "contamination-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Words(WORD_BYTES)
        for batch in batches:
            data, offsets = utf8(batch.column("t"))
            sizes = [split(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])[1] for a, b in pieces(offsets)]
            own = [batch.column(c) for c in (*head, "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]))], [*head, "k1", "k2", "n_words"])

    kinds = ", ".join(f"{name} {docs.schema[c].dataType.simpleString()}" for c, name in zip(keep, head))
    marked = may_hold(rows, F.col("k1"), hits, F.col("k1"))
    clear, rest = (marked.where(side).drop("maybe").mapInArrow(released(count), f"{kinds}, k1 long, k2 long, n_words long") for side in ("not maybe", "maybe"))
    rest = rest.join(hits, ["k1", "k2"], "left").select(*head, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    clear = clear.select(*head, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    return clear.unionByName(rest).withColumnsRenamed(dict(zip(head, keep)))


def op4(spark, sf_dir: str) -> DataFrame:
    df = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
v AS (SELECT item, w, least(len(w), {WIDTH}) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS z FROM v),
ks AS (SELECT DISTINCT k FROM v),
dw AS (SELECT r, k, unnest(list_transform(range(len(w) - k + 1), lambda i: {{'p': i, 'z': array_to_string(w[i + 1:i + k], ' ')}})) AS s FROM d, ks WHERE len(w) >= k),
h AS (SELECT dw.r, dw.s.p AS p, dw.k AS k, iw.item FROM dw JOIN iw ON iw.k = dw.k AND iw.z = dw.s.z),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
