"""Embedding whitening by weighted multiplicity covariance.

Vectors become vectors of whole numbers, x = floor(scale * entry). Rows with the same x vector are one group with a count, so the fit
and the projection see each distinct vector once. Fit weights are one for each distinct vector or its count. The fit takes two passes
over the distinct vectors, each a partial result for every task and one aggregate over those: exact sums S for each dimension, then the
weighted products of x - S/n. Each task centres before it multiplies; the whole part of S/n is taken off exactly. The driver gets one
matrix of dimension x dimension, whose size depends on the vectors' length alone, and finds its eigenvectors. Each distinct vector is
whitened once; rows are joined back by 128 bits of hashes of their vector, those of groups that hold over 1/1024 of all rows (fewer
than 1024 groups) by a broadcast join, so that no task gets a hot group.

Defined results: a row whose vector is null or holds null or non-finite entries has no result; neither have empty vectors and empty
tables. Entries beyond the range of a long are taken as its ends. Vectors of different lengths are fitted apart. Components whose
eigenvalue is zero within rounding (below 1e-12 of the largest, or below length * 1e-15 of the trace) are left out, so a fit of one
distinct vector has none. A deviation beyond a long is null. Rows are kept as often as they come, missing ids too; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import released, stored

COMPONENTS = 4
SCALE = 256
HOT_SHARE = 1024  # a group is hot if it holds more than this part of the rows
LARGEST = 9.2233720368e18


def whole_numbers(vector: Column, scale: int) -> Column:
    """The vector in whole numbers; null if it is null or holds null or non-finite entries."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(fine, F.transform(doubles, lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-LARGEST)), F.lit(LARGEST)))))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and x of a batch, one matrix for each length of vector."""
    column = batch.column("x")
    offsets = np.asarray(column.offsets).astype(np.int64)
    sizes = np.diff(offsets)
    flat = np.asarray(column.values).astype(np.int64, copy=False)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, at, n, s): per task, length and dimension the weight and the exact sum."""
    total: dict[int, list] = {}
    for batch in batches:
        weight = np.asarray(batch.column("weight")).astype(np.int64)
        for rows, x in matrices(batch):
            n, s = total.get(x.shape[1], (0, [0] * x.shape[1]))
            total[x.shape[1]] = n + int(weight[rows].sum()), [a + b for a, b in zip(s, _exact(x, weight[rows]))]
    for d, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))],
            ["d", "at", "n", "s"])


def _exact(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted column sums as Python's whole numbers."""
    if float(np.abs(x.astype(np.float64)).max()) * float(w.sum()) < 2.0**62:
        return (x * w[:, None]).sum(axis=0).tolist()
    return (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist()


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - s/n in doubles; the whole part goes exactly."""
    whole = np.array([v // n for v in s], np.int64)
    rest = np.array([v % n / n for v in s])
    near = np.abs(x.astype(np.float64) - whole) < 2.0**62
    return np.where(near, x - whole, x.astype(np.float64) - whole) - rest


def _products(means: dict[int, tuple[int, list[int]]]):
    """(d, at, row): per task and length the weighted centred products, a row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = np.asarray(batch.column("weight")).astype(np.float64)
            for rows, x in matrices(batch):
                y = centred(x, *means[x.shape[1]])
                total[x.shape[1]] = total.get(x.shape[1], 0) + (y * weight[rows][:, None]).T @ y
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["d", "at", "row"])

    return run


def axes(matrix: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (as columns) by falling value, without those of no spread."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = max(float(np.trace(matrix)), 0.0)
    there = (values > 0) & (values > 1e-12 * values[:1].max(initial=0)) & (values > len(values) * 1e-15 * trace)
    return values[there][:components], vectors[:, there][:, :components]


def deviations(x: np.ndarray, n: int, s: list[int]) -> pa.Array:
    """Sums of (n*x - s)^2, exact: numbers modulo 2^64 are right wherever the sum is a long."""
    rough = ((x.astype(np.float64) * float(n) - np.array(s, np.float64)) ** 2).sum(axis=1)
    with np.errstate(over="ignore"):
        y = x.astype(np.uint64) * np.uint64(n) - np.array([v % (1 << 64) for v in s], np.uint64)
        out = (y * y).sum(axis=1, dtype=np.uint64).view(np.int64)
    sure = rough < LARGEST * (1 - 1e-9)
    found = [int(v) if fine else sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for v, fine, row in zip(out.tolist(), sure.tolist(), x)] if not sure.all() else out.tolist()
    return pa.array([v if v < 1 << 63 else None for v in found], pa.int64())


def _whitened(fits: dict[int, tuple]):
    """Of distinct vectors: their key, weight, length, deviation and whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch):
                n, s, values, vectors = fits[x.shape[1]]
                w = centred(x, n, s) @ vectors / np.sqrt(values)
                kept = [batch.column(c).take(pa.array(rows)) for c in ("k1", "k2", "copies", "weight")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(np.full(len(rows), x.shape[1], np.int32)), deviations(x, n, s), pa.array(list(w), pa.list_(pa.float64()))],
                    ["k1", "k2", "copies", "weight", "d", "deviation", "w"])

    return run


def identity_errors(white: DataFrame, sizes: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Per length: the largest entry of the whitened vectors' covariance minus the identity, centred on their own mean."""
    wide = max((k for _, k in sizes.values()), default=0)
    if not wide:
        return {d: 0.0 for d in sizes}
    means = {r["d"]: [r[f"m{i}"] for i in range(wide)] for r in white.groupBy("d").agg(
        *[(F.sum(F.col("weight") * F.get("w", F.lit(i))) / F.sum("weight")).alias(f"m{i}") for i in range(wide)]).collect()}
    pairs = [(i, j) for i in range(wide) for j in range(i, wide)]
    errors = {}
    for d, (n, k) in sizes.items():
        mine = [(i, j) for i, j in pairs if j < k]
        off = [F.get("w", F.lit(i)) - F.lit(m) for i, m in enumerate(means[d][:k])]
        sums = white.where(F.col("d") == d).agg(F.lit(0.0).alias("none"), *[F.sum(F.col("weight") * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in mine]).first()
        errors[d] = max((abs(sums[f"c{i}_{j}"] / n - (i == j)) for i, j in mine), default=0.0)
    return errors


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, by_copies: bool = False) -> DataFrame:
    """Per row and component: id, component, n (weight of the fit), deviation, whitened, explained, identity_error, n_copies (rows with this vector).

    `by_copies` fits with the number of rows of each vector as its weight, else every distinct vector weighs one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col), scale).alias("x")).where("size(x) > 0")
    keys = [F.xxhash64("x").alias("k1"), F.xxhash64(F.lit("second"), "x").alias("k2")]
    groups = rows.groupBy("x").agg(F.count("*").alias("copies"))
    weight = F.col("copies") if by_copies else F.lit(1).cast("bigint")
    distinct = stored(groups.select("x", *keys, "copies", weight.alias("weight")), "whitening-distinct")

    sums = distinct.select("x", "weight").mapInArrow(released(_sums), "d int, at int, n long, s decimal(38,0)")
    means: dict[int, tuple[int, list[int]]] = {}
    for r in sums.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "at").collect():
        means.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    products = distinct.select("x", "weight").mapInArrow(released(_products(means)), "d int, at int, row array<double>")
    cells = products.select("d", "at", F.posexplode("row").alias("to", "v")).groupBy("d", "at", "to").agg(F.sum("v").alias("v"))
    matrix = {d: np.zeros((d, d)) for d in means}
    for d, at, to, v in cells.toPandas().itertuples(index=False):
        matrix[d][at, to] = v / means[d][0]
    fits = {d: (n, s, *axes(matrix[d], components)) for d, (n, s) in means.items()}

    white = stored(distinct.mapInArrow(released(_whitened(fits)), "k1 long, k2 long, copies long, weight long, d int, deviation long, w array<double>"), "whitening-whitened")
    errors = identity_errors(white, {d: (n, len(values)) for d, (n, _, values, _) in fits.items()})
    facts = [(d, int(n), float(errors[d]), [float(e / np.trace(matrix[d])) for e in values]) for d, (n, _, values, _) in fits.items()]
    lengths = spark.createDataFrame(facts, "d int, n long, identity_error double, explained array<double>")

    total = white.agg(F.sum("copies").alias("rows")).first()["rows"] or 0
    hot = F.col("copies") * HOT_SHARE > total
    part = rows.select("id", *keys)
    result = white.select("k1", "k2", "copies", "d", "deviation", "w")
    frequent = result.where(hot)  # fewer than HOT_SHARE rows
    marked = part.join(F.broadcast(frequent), ["k1", "k2"], "left")
    joined = marked.where("d is not null").unionByName(marked.where("d is null").select("id", "k1", "k2").join(result.where(~hot), ["k1", "k2"]))
    # `lengths` has a row for each length of vector that the driver has fitted
    wide = joined.join(F.broadcast(lengths), "d")
    return wide.select("id", "n", "deviation", "identity_error", "copies", F.posexplode(F.arrays_zip("w", "explained")).alias("at", "c")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.w").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error", F.col("copies").alias("n_copies"))


def op12(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
