"""Splits, draws and plans: hand cases, invariants, and independence of partitioning."""

from collections import Counter

import pytest
from draws import uniform
from pyspark.sql import functions as F

from tokenmill.operators import sampling as S
from tokenmill.operators.prefix import position, running_total, shuffled_position
from tokenmill.operators.rangejoin import range_join


def test_split_specs():
    assert S.parse_split("949,50,1") == pytest.approx([0.949, 0.05, 0.001])
    assert S.parse_split("8/1/1", has_valid=True) == pytest.approx([8 / 9, 0, 1 / 9])
    assert S.parse_split("0.9") == pytest.approx([0.9, 0.1, 0.0])
    assert not S.should_split([10, 0, 0])
    assert S.should_split([1, 0.1, 0.2])


def test_split_bounds_overlap():
    assert S.split_bounds(10, [949, 50, 1]) == [(0, 9), (9, 10), (9, 10)]
    assert S.split_bounds(10, [1, 0, 0]) == [(0, 10), None, None]
    assert S.split_bounds(10, [0.5, 0.25, 0.25]) == [(0, 5), (5, 7), (7, 10)]


def test_split_rows_overlap(spark):
    rows = S.split_rows(spark.range(10).withColumnRenamed("id", "doc_id"), ["doc_id"], S.parse_split("949,50,1")).collect()
    assert Counter(r["split"] for r in rows) == {"train": 9, "valid": 1, "test": 1}


def test_positions_with_gaps_and_hot_group(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 100_003).alias("k"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("g"))
    rows = position(df, "k", within=["g"]).collect()
    for group in {r["g"] for r in rows}:
        mine = sorted((r["k"], r["pos"]) for r in rows if r["g"] == group)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_positions_of_sparse_ids(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("k"), F.when(F.col("id") % 2 == 0, "g").alias("g"), F.lit("x").alias("other"))
    for within in ([], ["g"]):
        rows = position(df, "k", within=within).collect()
        for group in {r["g"] if within else 0 for r in rows}:
            mine = sorted((r["k"], r["pos"]) for r in rows if not within or r["g"] == group)
            assert [p for _, p in mine] == list(range(len(mine))) and len(mine) == (1000 if within else 2000)


def test_running_total(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    before = {r["id"]: r["before"] for r in running_total(df, "id", F.col("v")).collect()}
    total = 0
    for i in range(1000):
        assert before[i] == total
        total += i % 7


def test_shuffle_is_a_permutation_and_ignores_partitioning(spark):
    results = []
    for partitions in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        df = shuffled_position(spark.range(500).repartition(partitions), "s", ["id"])
        results.append(sorted((r["pos"], r["id"]) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
    assert [p for p, _ in results[0]] == list(range(500))


def test_range_join_with_one_huge_interval(spark):
    intervals = spark.createDataFrame([(0, 0, 5), (1, 5, 5), (2, 5, 10_000), (3, 10_000, 10_001)], "doc long, lo long, hi long")
    points = spark.range(10_001).withColumnRenamed("id", "p")
    rows = range_join(points, "p", intervals, "lo", "hi", 64).collect()
    assert len(rows) == 10_001
    assert Counter(r["doc"] for r in rows) == {0: 5, 2: 9995, 3: 1}


def test_weighted_draws_follow_weights(spark):
    docs = spark.createDataFrame([(i, 1000 if i == 7 else 10) for i in range(101)], "doc_id long, w int")
    line = S.weight_line(docs, "doc_id", F.col("w"))
    draws = S.weighted_draws(spark.range(4000).withColumnRenamed("id", "d"), ["d"], line, "x", 64)
    counts = Counter(r["doc_id"] for r in draws.collect())
    assert sum(counts.values()) == 4000
    assert 1800 < counts[7] < 2200


def test_partner_is_never_self(spark):
    df = position(spark.range(200).withColumnRenamed("id", "doc_id"), "doc_id")
    rows = S.partner_positions(df.drop("pos"), "doc_id", "p").collect()
    assert all(r["partner_pos"] != r["pos"] and 0 <= r["partner_pos"] < 200 for r in rows)


@pytest.mark.parametrize(("batch", "consumers"), [(24, 5), (8, 4), (6, 4)])
def test_batch_plan_slices(spark, batch, consumers):
    rows = S.batch_plan(spark.range(batch * 2).withColumnRenamed("id", "doc_id"), "doc_id", batch, consumers).collect()
    for r in rows:
        assert r["consumer"] * batch // consumers <= r["slot"] < (r["consumer"] + 1) * batch // consumers


def test_batch_plan_resume_and_drop_last(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert S.batch_plan(df, "doc_id", 8, 2, drop_last=True, start_batch=2).count() == 32
    assert S.batch_plan(df, "doc_id", 8, 2).count() == 50


def test_scatter_partitions_rows(spark):
    rows = S.scatter(spark.range(103).withColumnRenamed("id", "doc_id"), ["doc_id"], 10).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == 103 and max(sizes.values()) == 11 and len({r["doc_id"] for r in rows}) == 103


def test_task_mix_with_many_tasks(spark):
    """100,000 tasks, one of which holds a third of the rows."""
    n = 100_000
    tasks = spark.range(n).select(F.concat(F.lit("t"), F.lpad("id", 6, "0")).alias("task"), F.col("id").alias("row"))
    big = spark.range(n // 2).select(F.lit("t050000").alias("task"), (F.col("id") + n).alias("row"))
    weights = S.task_weights(tasks.union(big), "task", 0.5).orderBy("task").collect()
    assert len(weights) == n and weights[0]["lo"] == 0
    assert all(abs(w["hi"] - v["lo"]) < 1e-9 and abs(v["hi"] - v["lo"] - v["n"] ** 0.5) < 1e-6 for w, v in zip(weights, weights[1:]))
    draws = spark.range(3000).withColumnRenamed("id", "draw")
    drawn = S.mixed_task_draws(draws, "draw", tasks.union(big), "task", "row", "m", temperature=1.0).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(3000))
    assert 800 < sum(r["task"] == "t050000" for r in drawn) < 1200
    total = n + n // 2
    for r in drawn:
        u = uniform("m-task", r["draw"]) * total
        want = int(u) if u < 50_000 else 50_000 if u < 50_001 + n // 2 else int(u) - n // 2
        assert r["task"] == f"t{want:06d}" and (r["row"] == want if want != 50_000 else r["row"] == 50_000 or r["row"] >= n)
