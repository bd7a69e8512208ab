"""Sharding: counts, places, sizes, checksums, and links kept, against the least possible number of cut groups."""

import random
import zlib
from collections import Counter
from itertools import product

import pytest

from tokenmill.llm import sharding

KIND = "doc_id long, text string, g string, n long, row long, shard int, cut boolean"


def run(spark, rows, shards):
    frame = spark.createDataFrame([(i, t, "g", 1, 2, 3, True) for i, t in rows], KIND)
    got = sharding.shard(frame, shards=shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(shards)) and max(counts.get(s, 0) for s in range(shards)) - min(counts.get(s, 0) for s in range(shards)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    homes = {}
    for r in got:
        homes.setdefault((r["text_crc32"], r["size"]), Counter())[r["shard"]] += 1
    assert all(r["whole"] == (len(homes[r["text_crc32"], r["size"]]) == 1) for r in got)
    return homes


def cut(homes):
    return sum(len(h) > 1 for h in homes.values())


def least_cut(sizes, shards):
    """The least number of groups that are cut, over all ways to put whole groups into shards of the law's counts."""
    total, groups = sum(sizes), [n for n in sizes if n > 1]
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    best = len(groups)
    for homes in product(range(-1, shards), repeat=len(groups)):
        load = [0] * shards
        for n, s in zip(groups, homes):
            if s >= 0:
                load[s] += n
        if all(a <= b for a, b in zip(load, quota)):
            best = min(best, sum(s < 0 for s in homes))
    return best


def documents(sizes):
    rows = [f"text {k}" for k, n in enumerate(sizes) for _ in range(n)]
    random.Random(1).shuffle(rows)
    return list(enumerate(rows))


def test_groups_that_fill_shards_exactly(spark):
    homes = run(spark, documents([50] * 800), 40)
    assert len(homes) == 800 and cut(homes) == 0


def test_hot_group_and_large_groups(spark):
    homes = run(spark, documents([400, 150, 90, 30, 30, 7, 7, 5] + [2] * 60 + [1] * 361), 10)  # 120 in a shard
    sizes = {sum(h.values()): len(h) for h in homes.values()}
    assert sizes[400] == 4 and sizes[150] == 2 and cut(homes) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_against_the_optimum(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(2, 9) for _ in range(7)] + [1] * rng.randrange(3, 20)
    assert least_cut(sizes, 3) <= cut(run(spark, documents(sizes), 3)) <= least_cut(sizes, 3) + 1
    loose = sizes + [1] * 40  # documents without a link leave room for every group
    assert cut(run(spark, documents(loose), 3)) == least_cut(loose, 3) == 0


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, None), (None, "a"), (None, "a"), (4, "b"), (4, "b"), (4, "b"), (5, "é漢😀"), (6, "x" * 13_000_000), (7, "x" * 13_000_000)]
    homes = run(spark, rows, 2)
    assert cut(homes) <= 1
    run(spark, rows[:3], 5)
    assert sharding.shard(spark.createDataFrame([], KIND), shards=4).count() == 0
