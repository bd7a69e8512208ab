"""Seeded randomness as a pure function of row keys.

`rand()` depends on how rows fall into partitions, so a lost executor could change a sample. Everything random here is a
hash of (seed, key): it survives retries and repartitioning, and any other engine with md5 can reproduce it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A

HASH_BITS = 60  # 15 hex digits


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def hash_hex(seed: str | int, *keys) -> Column:
    """Hex digest of the seed and the keys; its text order is a random permutation."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]))


def hash_int(seed: str | int, *keys) -> Column:
    """Integer in [0, 2^60)."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def hash_uniform(seed: str | int, *keys) -> Column:
    """Double in [0, 1)."""
    return hash_int(seed, *keys).cast("double") / F.lit(float(1 << HASH_BITS))


def hash_below(bound, seed: str | int, *keys) -> Column:
    """Integer in [0, bound)."""
    return F.pmod(hash_int(seed, *keys), F.lit(bound).cast("bigint") if not isinstance(bound, Column) else bound.cast("bigint"))


def hashes_of(places: Column, seed: str | int, *keys) -> Column:
    """`hash_hex(seed, *keys, p)` for each p of an array; what the hashed texts have in common is made once."""
    return A.let(_begun(seed, *keys), lambda b: F.transform(places, lambda p: F.md5(F.concat(b, p.cast("string")))))


def first_above(hashed: Column, bounds: Sequence[float]) -> Column:
    """How many of the ascending `bounds` are at most `hash_uniform`, from its hash_hex; digits are compared, up to the first larger bound."""

    def digits(bound: float) -> str:
        low, high = 0, 1 << HASH_BITS  # the least number whose double is `bound` or more
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if float(middle) / float(1 << HASH_BITS) >= bound else (middle + 1, high)
        return f"{low:0{HASH_BITS // 4}x}" if low < 1 << HASH_BITS else "g"  # behind all digits

    def count(h: Column) -> Column:
        found = None
        for k, bound in enumerate(bounds):
            found = (F if found is None else found).when(h < digits(bound), F.lit(k))
        return found.otherwise(F.lit(len(bounds)))

    return A.let(hashed, count)


def _begun(seed: str | int, *keys) -> Column:
    return F.concat(F.concat_ws("|", F.lit(str(seed)), *[_col(k).cast("string") for k in keys]), F.lit("|"))


def heads(count: Column, seed: str | int, *keys) -> Column:
    """How many of the integers i from 0 up to `count` have `hash_uniform(seed, *keys, i) < 0.5`.

    What the hashed texts have in common is made once, and digits are compared as they are: as a double any number from 2^59 - 32 on is 2^59, a half.
    """
    half = f"{(1 << (HASH_BITS - 1)) - 32:0{HASH_BITS // 4}x}"
    return A.let(_begun(seed, *keys), lambda b: F.size(F.filter(A.counting(0, count), lambda i: F.md5(F.concat(b, i.cast("string"))) < half)))
