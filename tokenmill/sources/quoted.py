"""Quoted tables whose fields hold line ends, read in parallel.

A file block doesn't know whether it begins inside a quoted field. Each line is a map from the reader's state at its start to the state
at its end; at a line's start only two of the four states (start of a field, in a plain field, in a quoted field, behind a quote that may close it)
are possible: a new record, or inside a quoted field. The maps of a block's lines are composed in file order to one map for each block with the number
of records that end in it, for both states. A prefix scan over blocks, one row each, gives every block its true state and first record
number. A second pass joins lines to records inside their block; pieces of records that span blocks meet by record number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, PLAIN, QUOTED, BEHIND = range(4)
BLANK = ("", "\r")


def ends_open(line: Column, sep: str, state: int) -> Column:
    """Whether a line that begins in `state` ends inside a quoted field."""

    def text(before: Column, piece: Column) -> Column:
        return F.when((before == QUOTED) | (piece == ""), before).when(F.endswith(piece, F.lit(sep)), START).otherwise(PLAIN)

    def quote(before: Column) -> Column:
        return F.when((before == START) | (before == BEHIND), QUOTED).when(before == QUOTED, BEHIND).otherwise(before)

    pieces = F.split(line, '"', -1)
    return F.aggregate(F.slice(pieces, 2, F.length(line) + 1), text(F.lit(state), F.get(pieces, F.lit(0))), lambda s, p: text(quote(s), p), lambda s: s == QUOTED)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file block: whether it ends open and how many records end in it, if it begins with a record and if it begins inside a field."""
    rows: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        plain, quoted, blank = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)).tolist() for c in ("plain", "quoted", "blank"))
        for key, a, b, empty in zip(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()), plain, quoted, blank):
            own = rows.setdefault(key, [0, 1, 0, 0])
            for s in (0, 1):
                after = b if own[s] else a
                own[2 + s] += not after and not (empty and not own[s])
                own[s] = int(after)
    columns = list(zip(*((*key, *map(bool, own[:2]), *own[2:]) for key, own in rows.items()))) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "block", "plain", "quoted", "n_plain", "n_quoted"])


def block_starts(blocks: DataFrame) -> DataFrame:
    """Per block: whether it begins inside a quoted field, and the number of the record that ends first in it."""
    # One row for each file block. A map keeps the state, turns it over, or gives the same for both.
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = blocks.withColumn("turns", F.sum(F.when(F.col("plain") & ~F.col("quoted"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("plain") == F.col("quoted"), F.struct(F.col("plain").cast("int").alias("state"), "turns"))
    known = turns.withColumn("known", F.last(fixed, ignorenulls=True).over(earlier)).withColumn("before", F.coalesce(F.lag("turns").over(order), F.lit(0)))
    state = (F.coalesce("known.state", F.lit(0)) + F.col("before") - F.coalesce("known.turns", F.lit(0))) % 2 == 1
    found = known.select("file", "block", state.alias("inside"), F.when(state, F.col("quoted")).otherwise(F.col("plain")).alias("open"), F.when(state, F.col("n_quoted")).otherwise(F.col("n_plain")).alias("n"))
    found = found.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1
    files = found.withColumn("last", last).groupBy("file").agg(F.sum(F.col("n") + (F.col("last") & F.col("open")).cast("int")).alias("records"))
    # One row for each file; shorter names first, then by name.
    across = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("records").over(across), F.lit(0)).alias("files"))
    return found.join(files, "file").select("file", "block", "inside", (F.col("first") + F.col("files")).alias("first"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per record, or piece of one at a block's edges: its number, the block, the text, and whether it is whole."""
    key, state, lines, number, whole = None, False, [], 0, True
    for batch in batches:
        out: list[tuple[int, int, str, bool]] = []
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "inside", "first", "value", "plain", "quoted")]
        for file, block, inside, first, value, plain, quoted in zip(*columns):
            if key != (file, block):
                if lines:
                    out.append((number, key[1], "\n".join(lines), False))
                key, state, lines, number, whole = (file, block), inside, [], first, not inside
            if not state and value in BLANK:
                continue
            lines.append(value)
            state = quoted if state else plain
            if not state:
                out.append((number, block, "\n".join(lines), whole))
                lines, number, whole = [], number + 1, True
        yield _piece_batch(out)
    yield _piece_batch([(number, key[1], "\n".join(lines), False)] if lines else [])


def _piece_batch(rows: list[tuple[int, int, str, bool]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["line_no", "block", "value", "whole"])


def quoted_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """(line_no, value): the records of all files as text, numbered from 0; blank lines between records don't count.

    Scans of the same files under the same settings have the same blocks, which both passes rely on; a block that only one of
    them has fails the job.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.select("file", "block", "value", ends_open(F.col("value"), sep, START).alias("plain"), ends_open(F.col("value"), sep, QUOTED).alias("quoted"))
    blocks = lines.select("file", "block", "plain", "quoted", F.col("value").isin(*BLANK).alias("blank")).mapInArrow(
        _blocks, "file string, block long, plain boolean, quoted boolean, n_plain long, n_quoted long")
    # A row for each file block, that is, one for each spark.sql.files.maxPartitionBytes of input; a broadcast join keeps the lines in file order.
    placed = lines.join(F.broadcast(block_starts(blocks)), ["file", "block"], "left")
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("file blocks differ between two scans")).cast("boolean")).otherwise(F.col("inside"))
    parts = placed.withColumn("inside", known).select("file", "block", "inside", "first", "value", "plain", "quoted").mapInArrow(_records, "line_no long, block long, value string, whole boolean")
    torn = parts.where("not whole").groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"))
    joined = torn.select("line_no", F.array_join(F.transform("p", lambda p: p["value"]), "\n").alias("value"))
    records = parts.where("whole").select("line_no", "value").unionByName(joined)
    return records.withColumn("value", F.regexp_replace("value", "\r$", ""))


def quoted_table(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Headerless quoted table of string columns whose fields may hold line ends and doubled quotes, with the record's number."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    parsed = F.from_csv("value", F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true"})
    return quoted_records(spark, path, sep).select(parsed.alias("r"), "line_no").select("r.*", "line_no")
