"""Periodic run detection in texts: scale-tiled, stitched by document and period.

A run is a stretch of words in which words `period` apart are identical, with the smallest such period, at least two periods and
MIN_LENGTH words long, that no neighbouring word extends. Periods are searched by octave, P to 2P - 1. For each octave a text is cut into
overlapping tiles: a core of whole multiples of P, at least TILE words where the text has them, and a margin of 4P and more on both sides. Boundaries stand at
every P words of the core. A run of at least two periods has a boundary c with the whole period [c, c + q) inside, so it shows in the Z-functions
of the boundary, the common extensions of c and c + q to the right and to the left, whose sum reaches q. They come from hashes
of blocks of 2^k words, for all boundaries and periods of a tile at once: one of the two extensions reaches half of what is needed, so
one comparison of a block leaves few pairs. A tile gives back the distinct intervals inside it, without those whose period has a divisor that is one.
Fragments are shuffled by document and period; those that overlap by a period or more are one run. A run that goes through many tiles has one fragment
in each, so a group is bounded by the tiles of one text. Texts are not shuffled, but for those that hold fragments, which meet their runs to be collapsed.

Words are the bytes between white space (space, \\t to \\r), compared as they are. Equal blocks are equal up to 64-bit hashes.
Defined results: null and blank texts have no words, no runs and an empty collapsed text; rows are kept as often as they come, missing
ids too; columns other than id and text are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.llm.common import mixed, pieces, released, stored, utf8

MIN_LENGTH = 12
TILE = 1 << 16  # words of a tile's core
CUT_BYTES = 4 << 20  # of text that is split at once
TOP_LEVEL = 14  # log2 of the longest block that extensions are built from
SPACE = frozenset(b" \t\n\r\x0b\x0c")
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, cut by cut."""
    at = 0
    while at < len(raw):
        end = min(at + CUT_BYTES, len(raw))
        while end < len(raw) and raw[end] not in SPACE:
            end += 1
        yield raw[at:end].split()
        at = end


def numbers_of(raw: bytes) -> np.ndarray:
    """Per word the place where it comes first, which is the same for equal words alone."""
    first: dict[bytes, int] = {}
    out, n = [np.zeros(0, np.int64)], 0
    for words in words_of(raw):
        out.append(np.fromiter(map(first.setdefault, words, count(n)), np.int64, len(words)))
        n += len(words)
    return np.concatenate(out)


class Blocks:
    """Hashes of the blocks of 2^k neighbouring words, and common extensions of places by them."""

    def __init__(self, numbers: np.ndarray):
        self.n = len(numbers)
        self.levels = [mixed((numbers.astype(np.uint64) + np.uint64(1)) * _ODD)]
        self.above: tuple[int, np.ndarray] | None = None  # one level over TOP_LEVEL, which the search alone needs

    def level(self, k: int) -> np.ndarray:
        """Hashes by the block's first word."""
        while len(self.levels) <= min(k, TOP_LEVEL):
            self.levels.append(self._doubled(self.levels[-1], len(self.levels) - 1))
        if k <= TOP_LEVEL:
            return self.levels[k]
        if self.above is None or self.above[0] > k:
            self.above = TOP_LEVEL, self.levels[TOP_LEVEL]
        while self.above[0] < k:
            self.above = self.above[0] + 1, self._doubled(self.above[1], self.above[0])
        return self.above[1]

    @staticmethod
    def _doubled(level: np.ndarray, k: int) -> np.ndarray:
        size = 1 << k
        return mixed(level[:-size] * _ODD + level[size:]) if len(level) > size else np.zeros(0, np.uint64)

    def extension(self, i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
        """Equal words from places i < j on, or before them."""
        got = np.zeros(len(i), np.int64)
        room = i if left else self.n - j
        for k in range(min(TOP_LEVEL, max(0, self.n.bit_length() - 1)), -1, -1):
            size = 1 << k
            hashes = self.level(k)
            live = np.flatnonzero(got + size <= room)
            while len(live):
                far = -got[live] - size if left else got[live]
                live = live[hashes[i[live] + far] == hashes[j[live] + far]]
                got[live] += size
                live = live[got[live] + size <= room[live]]
        return got


def tile_intervals(blocks: Blocks, octave: int, first: int, last: int, least: int) -> np.ndarray:
    """Rows (start, end, period), with periods of `octave` to 2 * octave - 1, that show at boundaries first, first + octave, ... below last."""
    need = max(octave, least - 2 * octave + 1)  # the sum of the two extensions
    k = (need + 1 >> 1).bit_length() - 1
    half, hashes = 1 << k, blocks.level(k)
    rows = -(-(last - first) // octave)
    hit = np.zeros((rows, octave), bool)
    for shift in (0, -half):  # the block after the boundary, or before it
        skip = -(-max(0, -(first + shift)) // octave)
        begin = first + shift + skip * octave
        whole = min(rows - skip, max(0, (len(hashes) - begin) // octave - 1))
        if whole > 0:
            hit[skip:skip + whole] |= hashes[begin + octave:begin + (whole + 1) * octave].reshape(whole, octave) == hashes[begin:begin + whole * octave:octave, None]
        at = begin + whole * octave
        rest = hashes[at + octave:at + 2 * octave]
        if skip + whole < rows and len(rest):
            hit[skip + whole, :len(rest)] |= rest == hashes[at]
    pairs = np.flatnonzero(hit)
    if not len(pairs):
        return np.zeros((0, 3), np.int64)
    place = first + pairs // octave * octave
    period = octave + pairs % octave
    right = blocks.extension(place, place + period)
    left = blocks.extension(place, place + period, left=True)
    fine = (left + right >= period) & (left + right + period >= least)
    found = np.stack([(place - left)[fine], (place + period + right)[fine], period[fine]], axis=1)
    if not len(found):
        return found
    found = np.unique(found, axis=0)
    return found[smallest(blocks, found)]


def smallest(blocks: Blocks, found: np.ndarray) -> np.ndarray:
    """Whether no proper divisor of the period is one: period / r is none for any prime r that divides it."""
    start, end, period = found.T
    good, rest, r = np.ones(len(found), bool), period.copy(), 2

    def test(own: np.ndarray, r: np.ndarray | int) -> None:
        part = period[own] // r
        good[own] &= blocks.extension(start[own], start[own] + part) < end[own] - start[own] - part

    while r * r <= rest.max(initial=0):
        own = np.flatnonzero(rest % r == 0)
        if len(own):
            test(own, r)
        while len(own):
            rest[own] //= r
            own = own[rest[own] % r == 0]
        r += 1
    left = np.flatnonzero(rest > 1)  # primes
    test(left, rest[left])
    return good


def fragments(numbers: np.ndarray, longest: int, least: int = MIN_LENGTH, tile: int = TILE) -> np.ndarray:
    """Rows (start, end, period) of all tiles of a text, or of texts of up to `longest` words with numbers of their own between them."""
    n, octave, window, blocks = len(numbers), 1, None, None
    found = [np.zeros((0, 3), np.int64)]
    while longest >= max(least, 2 * octave):
        core, margin = max(tile, octave), 4 * octave + least
        for first in range(0, n, core):
            begin, end = max(0, first - margin), min(n, first + core + margin)
            if window != (begin, end):
                window, blocks = (begin, end), Blocks(numbers[begin:end])
            found.append(tile_intervals(blocks, octave, first - begin, min(first + core, n) - begin, least) + [begin, begin, 0])
        octave *= 2
    return np.concatenate(found)


def fragments_of(texts: list[bytes], least: int, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, number of words, fragments) of every text. Texts of about the same length share a tile: a word of its own after each keeps them apart."""
    numbers = [numbers_of(t) for t in texts]
    todo, at = sorted(range(len(texts)), key=lambda k: len(numbers[k])), 0
    while at < len(todo):
        last, size = at + 1, len(numbers[todo[at]]) + 1
        while last < len(todo) and size + len(numbers[todo[last]]) < tile:
            size += len(numbers[todo[last]]) + 1
            last += 1
        own = todo[at:last]
        flat = np.concatenate([part for k in own for part in (numbers[k], [-1 - k])])
        starts = np.concatenate([[0], np.cumsum([len(numbers[k]) + 1 for k in own])])
        found = fragments(flat, len(numbers[own[-1]]), least, tile)
        found = found[np.argsort(found[:, 0], kind="stable")]
        cuts = np.searchsorted(found[:, 0], starts)
        for i, k in enumerate(own):
            yield k, len(numbers[k]), found[cuts[i]:cuts[i + 1]] - [starts[i], starts[i], 0]
        at = last


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a column with the first one's row, nulls as empty, about CUT_BYTES at a time."""
    data, offsets = utf8(column)
    for first, last in pieces(offsets, CUT_BYTES):
        yield first, [data[offsets[k]:offsets[k + 1]].tobytes() for k in range(first, last)]


def _plain(least: int, tile: int):
    """Of texts without fragments: id, number of words, no runs, the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column("t")):
                own = [(k, n) for k, n, found in fragments_of(texts, least, tile) if not len(found)]
                joined = pa.array([b" ".join(b" ".join(words) for words in words_of(texts[k]) if words).decode() for k, _ in own], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([first + k for k, _ in own], pa.int64())), pa.array([n for _, n in own], pa.int64()), joined], ["id", "n_words", "collapsed"])

    return run


def _suspects(least: int, tile: int):
    """Of texts with fragments: key, id, text, number of words and the fragments."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column("t")):
                own = [(first + k, n, [dict(zip(("start", "end", "period"), r)) for r in found.tolist()]) for k, n, found in fragments_of(texts, least, tile) if len(found)]
                rows, sizes, found = zip(*own) if own else ([], [], [])
                kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("key", "id", "t")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(found, kind)], ["key", "id", "t", "n_words", "fragments"])

    return run


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words go if a run contains them after its first period."""
    for batch in batches:
        texts, runs, sizes = [], batch.column("runs"), np.asarray(batch.column("n_words"))
        for row, raw in ((first + k, raw) for first, part in _texts(batch.column("t")) for k, raw in enumerate(part)):
            own = runs[row].values
            start, length, period = (np.asarray(own.field(c)) for c in ("start", "length", "period"))
            step = np.zeros(sizes[row] + 1, np.int64)
            np.add.at(step, start + period, 1)
            np.add.at(step, start + length, -1)
            keep = (np.cumsum(step) == 0).tolist()
            at, parts = 0, []
            for words in words_of(raw):
                parts += [b" ".join(left)] if (left := list(compress(words, keep[at:at + len(words)]))) else []
                at += len(words)
            texts.append(b" ".join(parts).decode())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), runs, pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])


def stitched(parts: DataFrame) -> DataFrame:
    """Fragments (key, start, end, period) joined to runs (key, start, end, period): they overlap by a period or more."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= F.col("reach") - F.col("period"), 0).otherwise(1)
    named = parts.withColumn("reach", reach).withColumn("run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH, tile: int = TILE) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period, by start and then period) and the text without the repeated periods.

    `tile` is a power of two.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "id", "t")  # written down with the suspects, so it stays
    suspects = stored(keyed.mapInArrow(
        released(_suspects(least, tile)), f"key long, id {kind}, t string, n_words long, fragments array<struct<start:long,end:long,period:long>>"), "runs-suspects")
    parts = suspects.select("key", F.explode("fragments").alias("f")).select("key", "f.start", "f.end", "f.period")
    ordered = F.sort_array(F.collect_list(F.struct("start", "period", (F.col("end") - F.col("start")).alias("length"))))
    lists = stitched(parts).groupBy("key").agg(F.transform(ordered, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    met = suspects.drop("fragments").join(lists, "key").select("id", "t", "n_words", "runs")
    found = met.mapInArrow(released(_collapsed), f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")
    plain = rows.mapInArrow(released(_plain(least, tile)), f"id {kind}, n_words long, collapsed string")
    plain = plain.select("id", "n_words", F.array().cast(f"array<{RUN}>").alias("runs"), "collapsed")
    return plain.unionByName(found).withColumnRenamed("id", id_col)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of every tenth document by the checksum of its id repeat a stretch of their words up to the end."""
    check = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", F.floor(check / 10).alias("g"), F.when(check % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n = F.size("w").cast("long")
    chosen = F.col("w").isNotNull() & (n > 0)
    placed = words.select("doc_id", "text", "w", n.alias("n"), F.when(chosen, F.col("g") % n).alias("a"), (3 + F.col("g") % 8).alias("parts"))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / F.col("parts")))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a").cast("int") + 1, F.col("p").cast("int")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), rest.cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(text).alias("text"))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = periodic_runs(docs).withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
