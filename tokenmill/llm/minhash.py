"""MinHash near-duplicates by a multi-index Hamming join.

The signature of a set of word shingles is BITS bits of each of VALUES least hashes. Two sets of Jaccard similarity J differ at a
place with a chance of at most 1 - J, so the number of differing places of a pair at the threshold is at most binomial; DISTANCE is the least
number that such a pair exceeds with a chance below MISSED. Signatures are split into chunks of neighbouring places, so many that
one with DISTANCE differences in all has a chunk with ERRORS = 1 at most (pigeonhole). Every chunk's allowed errors are enumerated: one key
for each place that is left out. Two signatures that differ in one place of a chunk share the key without that place, equal chunks share all
of them, so every pair within DISTANCE shares a key; nothing else is left to chance.

Sets that share a key are a list; equal lists count once. In a list of up to 64 sets the pairs within DISTANCE are joined; longer lists,
which come from large groups of near copies, are joined whole. Sets joined this way are compared as whole sets, part by part, by
the Jaccard operator's trees, which confirm each link and give components. Equal sets are one class, told apart by a 64-bit hash.

Defined results: null, empty and blank texts have an empty set, link with nothing, make a component of their own and are kept; texts with
fewer words than a shingle have one shingle, all their words; repeated rows are links of each other, rows that share the component's id are
all kept; rows without an id are kept where no row of their component has one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import mixed, released, stored
from tokenmill.llm.components import components
from tokenmill.llm.jaccard import Shingles, _lists, class_of, confirmed, rows_of

WIDTH = 3
SHARE = (85, 100)  # of the union
VALUES, BITS = 128, 16
MISSED = 1e-7
ERRORS = 1  # places of a chunk that may differ
STEP_TOKENS = 1 << 15  # shingles that are hashed at once
_FACTORS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MASKS = mixed(_FACTORS)


def allowed_distance(values: int, share: tuple[int, int], missed: float) -> int:
    """The least number of differing places that a pair at the threshold exceeds with a chance below `missed`."""
    p = 1 - share[0] / share[1]
    chances = [comb(values, k) * p**k * (1 - p) ** (values - k) for k in range(values + 1)]
    return next(d for d in range(values + 1) if sum(chances[d + 1:]) < missed)


def chunk_edges(values: int, distance: int) -> np.ndarray:
    """First places of the chunks and the end: so many that one has ERRORS differences at most."""
    chunks = distance // (ERRORS + 1) + 1
    return np.arange(chunks + 1) * values // chunks


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of VALUES numbers of BITS bits for each set, none of them empty; least hashes of large sets are taken step by step."""
    out = np.zeros((len(sets), VALUES), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first + 1, len(sets[first])
        while last < len(sets) and size + len(sets[last]) <= STEP_TOKENS:
            size += len(sets[last])
            last += 1
        if last == first + 1:
            steps = [sets[first][i:i + STEP_TOKENS] for i in range(0, size, STEP_TOKENS)]
            for v in range(VALUES):
                out[first, v] = min(int(((s ^ _MASKS[v]) * _FACTORS[v]).min()) for s in steps)
        else:
            flat = np.concatenate(sets[first:last])
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first:last - 1]])])
            for v in range(VALUES):
                out[first:last, v] = np.minimum.reduceat((flat ^ _MASKS[v]) * _FACTORS[v], starts)
        first = last
    return (out >> np.uint64(16) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """Per document: id, hash of the id, size and class of its set; signatures come once for the equal sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingles(width)
        for batch in batches:
            sizes, keys, first, sets, signed, held = [], [], {}, [], [], 0

            def flush():
                signed.extend(row.tobytes() for row in signatures(sets))
                sets.clear()

            for row, own in enumerate(make(batch.column("t"))):
                key = class_of(own)
                sizes.append(len(own))
                keys.append(key)
                if len(own) and key not in first:
                    first[key] = row
                    sets.append(own)
                    held += len(own)
                    if held >= STEP_TOKENS:
                        flush()
                        held = 0
            flush()
            column = [None] * len(sizes)
            for row, value in zip(first.values(), signed):
                column[row] = value
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(column, pa.binary())], ["id", "h", "n", "k", "signature"])

    return docs.mapInArrow(released(run), f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, k long, signature binary")


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def error_keys(matrix: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per signature a key for each place: the hash of its chunk without that place."""
    place = np.arange(VALUES, dtype=np.uint64) + np.uint64(1)
    terms = mixed(matrix.astype(np.uint64) + (place << np.uint64(32)))
    whole = np.add.reduceat(terms, edges[:-1], axis=1)
    return mixed(np.repeat(whole, np.diff(edges), axis=1) - terms + place)


def _keys(edges: np.ndarray):
    """(key, k) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = error_keys(matrix_of(part.column("signature")), edges)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column("k")), VALUES))], ["key", "k"])

    return run


def _near(distance: int, share: tuple[int, int]):
    """Of rows (list, k, n, signature) that lie together by list: edges that join the sets within the distance, a tree for each component."""

    def edges(members: dict[int, tuple[int, bytes]]) -> Iterator[tuple[int, int]]:
        keys = np.array(list(members), np.int64)
        sizes = np.array([n for n, _ in members.values()], np.int64)
        matrix = np.frombuffer(b"".join(s for _, s in members.values()), np.uint16).reshape(-1, VALUES)
        left, reached = np.ones(len(keys), bool), []
        while left.any():
            reached = [int(np.argmax(left))]
            left[reached[0]] = False
            for at in reached:
                rest = np.flatnonzero(left)
                low, high = np.minimum(sizes[rest], sizes[at]), np.maximum(sizes[rest], sizes[at])
                near = rest[((matrix[rest] != matrix[at]).sum(axis=1) <= distance) & (share[1] * low >= share[0] * high)]
                left[near] = False
                reached += near.tolist()
                yield from ((int(keys[at]), int(keys[other])) for other in near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members, found = None, {}, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("list", "k", "n", "signature"))):
                if row[0] != name:
                    found += edges(members) if members else []
                    name, members = row[0], {}
                members[row[1]] = row[2], row[3]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found = []
        found += edges(members) if members else []
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """Per input row: id, n_shingles, n_links, component_id (the least id reachable) and whether the row is kept."""
    docs = rows_of(docs, id_col, text_col)
    distance = allowed_distance(VALUES, share, MISSED)
    narrow = stored(_signed(docs, width), "minhash-signatures")
    sets = stored(narrow.where("signature is not null").groupBy("k").agg(F.first("n").alias("n"), F.first("signature").alias("signature")), "minhash-sets")
    keys = sets.select("k", "signature").mapInArrow(released(_keys(chunk_edges(VALUES, distance))), "key long, k long")
    met = keys.repartition("key").sortWithinPartitions("key", "k").mapInArrow(released(_lists), "list long, a long, b long")
    met = stored(met.distinct(), "minhash-lists")
    members = met.where("list <> 0").select("list", F.col("a").alias("k"))
    near = members.join(sets, "k").select("list", "k", "n", "signature").repartition("list").sortWithinPartitions("list").mapInArrow(released(_near(distance, share)), "a long, b long")
    parts = components(met.where("list = 0").select("a", "b").unionByName(near))
    found = confirmed(docs, narrow.drop("signature"), parts, width, share)
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def op11(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept", "n_links")
