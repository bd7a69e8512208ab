"""Token-array helpers that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once.

    Inside a lambda an outer expression is evaluated again for every element; bound as a lambda variable it is not.
    """
    return F.transform(F.array(value), body)[0]


def indices(array: Column) -> Column:
    """0..n-1 for an array of n elements, empty for an empty one."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def counting(start: Column | int, count: Column) -> Column:
    """`count` consecutive integers from `start`."""
    start = start if isinstance(start, Column) else F.lit(start)
    return F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))


def repeat(value, count: Column) -> Column:
    return F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(count, F.lit(0)).cast("int"))


def take(array: Column, start: Column | int, count: Column | int) -> Column:
    """`count` elements from 0-based `start`, fewer at the end."""
    start = start if isinstance(start, Column) else F.lit(start)
    count = count if isinstance(count, Column) else F.lit(count)
    return F.slice(array, (start + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int"))


def head(array: Column, count: Column | int) -> Column:
    return take(array, 0, count)


def tail(array: Column, count: Column | int) -> Column:
    """The last `count` elements."""
    count = F.lit(count) if isinstance(count, int) else count
    return take(array, F.greatest(F.size(array) - count, F.lit(0)), count)


def drop(array: Column, count: Column | int) -> Column:
    return take(array, count, F.size(array))


def pad(array: Column, length: Column | int, value) -> Column:
    """Right-pad to `length`; longer arrays stay as they are."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.concat(array, repeat(value, length - F.size(array)))


def fit(array: Column, length: int, value) -> Column:
    """Exactly `length` elements: cut at the right, or pad at the right."""
    return pad(head(array, length), length, value)


def first_index(array: Column, value) -> Column:
    """0-based first position of a value, -1 when absent."""
    return (F.array_position(array, value) - 1).cast("int")


def last_index(array: Column, value) -> Column:
    """0-based last position of a value, -1 when absent."""
    from_end = F.array_position(F.reverse(array), value)
    return F.when(from_end == 0, F.lit(-1)).otherwise(F.size(array) - from_end).cast("int")


def positions_where(array: Column, test: Callable[[Column], Column]) -> Column:
    """0-based positions of the elements that pass a test, ascending."""
    marked = F.transform(array, lambda x, i: F.when(test(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def sublist_positions(array: Column, part: Column) -> Column:
    """All 0-based positions at which `part` occurs in `array`."""
    return let(F.struct(array.alias("a"), part.alias("p")), lambda v: F.filter(
        indices(v["a"]), lambda i: (v["a"][i] == v["p"][0]) & (F.slice(v["a"], i + 1, F.size(v["p"])) == v["p"])))


def plain(array: Column) -> Column:
    """The same array taken out of its row. A slice inside a lambda copies all of an array that is part of a row, and only its own elements of this one."""
    return F.flatten(F.array(array))


def flat_pairs(pairs: Column) -> Column:
    """Arrays of arrays of elements as one array. Inside a lambda F.array(a, b) is much cheaper than a concat of the two, which is interpreted there."""
    return F.flatten(F.flatten(pairs))


def running_sums(array: Column) -> Column:
    """Inclusive running sums; one pass that carries the total, linear for short arrays such as run lengths."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    folded = F.aggregate(array, start, lambda acc, x: F.struct(
        (acc["total"] + x).alias("total"), F.array_append(acc["sums"], acc["total"] + x).alias("sums")))
    return folded["sums"]


def exploded(df: DataFrame, keep: Sequence[Column | str], structs: Column, out: str) -> DataFrame:
    """`keep` and a row for each struct of an array, none for an empty one.

    For a plain explode Spark makes the array a second time, to leave out rows without elements.
    """
    return df.select(*keep, F.explode_outer(structs).alias(out)).filter(F.col(out).isNotNull())


def gather(df: DataFrame, keys: Sequence[str], order: str, value: Column | str, out: str) -> DataFrame:
    """Exploded rows back to one ordered array per key. The group is one row's worth of elements, e.g. one document."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias(out))
