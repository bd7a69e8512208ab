"""Global running sums and ranks without a single-task window.

Only the keys and the value of a row are sorted, by range over all tasks: a sample of the rows sets the ranges, so ids may be dense,
sparse or hashes, and a range has about as many rows as any other. The sorted rows are written down once, the sums within a range need
that range alone, and only one total for each range (and group) is summed over all of them. Rows come back to their columns by a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.hashing import hash_hex
from tokenmill.session import cut_lineage


def _running(df: DataFrame, keys: Sequence[str], value: Column, out: str, within: Sequence[str], first: Column | None = None, kind: str = "bigint") -> DataFrame:
    """Sums in the order of `first` (if given) and the keys; a null group is a group."""
    groups, names = [f"__w{i}" for i in range(len(within))], [f"__k{i}" for i in range(len(keys))]
    aliased = [F.col(c).alias(n) for c, n in zip([*within, *keys], [*groups, *names])]
    narrow = df.select(*aliased, value.cast(kind).alias("__value"), *([first.alias("__first")] if first is not None else []))
    order = [*(["__first"] if first is not None else []), *names]
    ranged = cut_lineage(narrow.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order))
    ranged = ranged.withColumn("__range", F.shiftright(F.monotonically_increasing_id(), 33))  # the partition
    inside = Window.partitionBy(*groups, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    totals = ranged.groupBy(*groups, "__range").agg(F.sum("__value").alias("__total"))
    # One row for each range of a group: no more than partitions and groups together.
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(earlier), F.lit(0))).drop("__total")
    ranked = _joined(ranged, totals, [*groups, "__range"]).select(*groups, *names, (F.col("__inside") + F.col("__offset")).alias(out))
    ranked = ranked.withColumnsRenamed(dict(zip([*groups, *names], [*within, *keys])))
    return ranked if set(df.columns) == {*within, *keys} else _joined(df, ranked, [*within, *keys])


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which null meets null."""
    right = right.withColumnsRenamed({c: f"__right_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in keys]
    return left.join(right, reduce(Column.__and__, same)).drop(*[f"__right_{c}" for c in keys])


def _list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def running_total(df: DataFrame, order: str | Sequence[str], value: Column, out: str = "before", within: Sequence[str] = (), kind: str = "bigint") -> DataFrame:
    """Add the sum of `value` over all rows that are earlier in `order` (unique in its group), per `within` group.

    Sums are of type `kind`; whole numbers and decimals come out the same however the rows are dealt.
    """
    return _running(df, _list(order), value, out, within, kind=kind)


def position(df: DataFrame, order: str | Sequence[str], out: str = "pos", within: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position in `order`, dense even where the ids have gaps."""
    return running_total(df, order, F.lit(1), out, within)


def shuffled_position(df: DataFrame, seed: str | int, keys: Sequence[str], out: str = "pos", within: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position in a random order fixed by (seed, keys); `keys` must be unique within a group."""
    return _running(df, list(keys), F.lit(1), out, within, first=hash_hex(seed, *keys))
