"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every document starts in a shard by its hash. In each round a join tells the documents of a text where most of
their neighbours are, or which shards have room for all of them where that one has none; since all neighbours of a document are
neighbours of each other, they ask to move there together. A shard takes what its quota leaves room for, larger groups first, by running sums over all
partitions. Whoever is refused asks again, in shards with room by the number of groups of this size that they can take; every round places at
least one group, and rounds go on until nobody can move. Groups that are larger than a shard fill whole shards first; groups that no shard has room for in the end -
there are fewer of them than shards, as each is larger than any room left - are cut over the largest rooms.
Then the law `rows` is made exact: one sort by shard, linked documents first, ranks everyone; what lies beyond a shard's quota, always documents without a
link, moves to the free places of the others. Counts are at most one apart, and places within a shard have no gaps.

Totals of shards and the groups that are cut reach the driver, no more rows than a few for each shard. Defined results: a null text is empty (size 16);
empty texts are linked as equal texts; repeated rows are linked documents; of rows equal in all, any may come first; columns other than id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.arrays import let
from tokenmill.llm.common import stored
from tokenmill.operators.prefix import position, running_total
from tokenmill.session import cut_lineage

SHARDS = 40


def _lookup(values: dict[int, float | int], key: Column, default) -> Column:
    """A value by shard; the table has one entry for each shard."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), key), F.lit(default)) if values else F.lit(default)


def _target(rooms: list[int], step: int) -> Column:
    """A shard with room for all n documents of a group, as likely as it has room for such groups; the first round prefers the shard where most of them are."""
    room = F.array(*map(F.lit, rooms))
    slots = F.transform(room, lambda r: F.floor(r / F.col("n")))
    total = F.aggregate(slots, F.lit(0).cast("long"), lambda n, s: n + s)
    begin = F.struct(F.pmod(F.xxhash64("g", F.lit(step)), total).alias("left"), F.lit(-1).alias("at"))
    walk = lambda found: F.aggregate(F.sequence(F.lit(0), F.lit(len(rooms) - 1)), begin, lambda a, s: F.when(a["at"] >= 0, a).otherwise(
        F.struct((a["left"] - F.get(found, s)).alias("left"), F.when(a["left"] < F.get(found, s), s).otherwise(-1).alias("at"))))["at"]
    other = F.when(total > 0, let(slots, walk))
    return F.when(F.get(room, F.col("shard")) >= F.col("n"), F.col("shard")).otherwise(other) if step == 0 else other


def propagate(groups: DataFrame, quota: list[int]) -> tuple[DataFrame, list[tuple[str, int, int, int]]]:
    """Groups of linked documents (g, n, shard: where most of them are) put into shards that hold up to `quota` documents each.

    Gives (g, shard) of groups that stay whole, and (g, first, end, shard) of the parts of those that are cut.
    """
    rooms, cut = list(quota), []

    def spread(g: str, n: int) -> None:
        first = 0
        while first < n:
            s = max(range(len(rooms)), key=lambda s: (rooms[s], -s))
            size = min(n - first, rooms[s])
            cut.append((g, first, first + size, s))
            rooms[s] -= size
            first += size

    for row in groups.where(F.col("n") > max(quota, default=0)).orderBy(F.desc("n"), "g").collect():  # fewer than shards
        spread(row["g"], row["n"])
    waiting = cut_lineage(groups.where(F.col("n") <= max(quota, default=0)))
    placed, step = [waiting.select("g", "shard").limit(0)], 0
    while True:
        asks = waiting.withColumn("target", _target(rooms, step)).where("target is not null").withColumn("order", -F.col("n"))
        ranked = running_total(asks, ["order", "g"], F.col("n"), "before", within=["target"])
        fits = F.col("before") + F.col("n") <= F.get(F.array(*map(F.lit, rooms)), F.col("target"))
        taken = stored(ranked.where(fits).select("g", "n", F.col("target").alias("shard")), "shard-taken")
        sums = taken.groupBy("shard").agg(F.sum("n").alias("n")).collect()
        if not sums:
            break
        for row in sums:
            rooms[row["shard"]] -= row["n"]
        placed.append(taken.select("g", "shard"))
        waiting = cut_lineage(waiting.join(taken, "g", "left_anti"))
        step += 1
    for row in waiting.orderBy(F.desc("n"), "g").collect():  # fewer than shards
        spread(row["g"], row["n"])
    return reduce(DataFrame.unionByName, placed), cut


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: id, size, text_crc32, shard and slot, under the law `rows`, and whether all documents with this text are in the shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.sha2(text, 256).alias("g"))
    start = F.pmod(F.xxhash64("id", "g", F.lit("start")), F.lit(shards)).cast("int")
    rows = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "start": start}), "shard-rows")  # written down, so the number stays
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    cells = rows.groupBy("g", "start").agg(F.count("*").alias("c"))
    most = F.max_by("start", F.struct("c", F.xxhash64("g", "start")))
    groups = stored(cells.groupBy("g").agg(F.sum("c").alias("n"), most.alias("shard")).where("n > 1"), "shard-groups")
    placed, cut = propagate(groups, quota)
    placed = stored(placed, "shard-placed")  # by itself, so that a hot group's join can be split
    parts = spark.createDataFrame(cut, "g string, first long, end long, part int")
    names = F.broadcast(parts.select("g").distinct().withColumn("cut", F.lit(True)))  # fewer than two for each shard
    rows = stored(rows.join(names, "g", "left").join(placed, "g", "left"), "shard-labels")
    ranked = position(rows.where("cut").select("g", "row"), "row", "rank", within=["g"])
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    numbered = ranked.join(F.broadcast(parts), "g").where(inside).select("row", "part")
    rows = rows.where("cut is null").withColumn("part", F.lit(None).cast("int")).unionByName(rows.where("cut").join(numbered, "row"))
    rows = rows.withColumns({"linked": F.col("cut").isNotNull() | F.col("shard").isNotNull(), "whole": F.col("cut").isNull(), "shard": F.coalesce("part", "shard", "start")})
    # one sort; a checkpoint keeps partitions and their order, so the number within a partition is a rank
    order = ["shard", F.desc("linked"), "g", "id"]
    rows = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "size", "crc", "shard", "whole"))
    rows = rows.withColumn("m", F.monotonically_increasing_id()).withColumns({"part": F.shiftright("m", 33).cast("int"), "within": F.col("m").bitwiseAND((1 << 33) - 1)})
    counts = rows.groupBy("part", "shard").count().collect()
    load, before = {}, {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["part"])):
        load[r["shard"]] = load.get(r["shard"], 0) + r["count"]
    parts = sorted({r["part"] for r in counts})
    sizes = {p: sum(r["count"] for r in counts if r["part"] == p) for p in parts}
    before = dict(zip(parts, accumulate([0, *[sizes[p] for p in parts]])))
    first = dict(zip(range(shards), accumulate([0, *[load.get(s, 0) for s in range(shards)]])))
    quota = dict(enumerate(quota))
    offsets = rows.sparkSession.createDataFrame([(p, n) for p, n in before.items() if p in sizes], "part int, before long")
    rows = rows.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("within") - _lookup(first, F.col("shard"), 0))
    # the k-th of all documents over quota takes the k-th free place
    over = dict(zip(range(shards), accumulate([0, *[max(0, load.get(s, 0) - quota[s]) for s in range(shards)]])))
    free = [(s, n, quota[s] - load.get(s, 0)) for s, n in zip(range(shards), accumulate([0, *[max(0, quota[s] - load.get(s, 0)) for s in range(shards)]])) if quota[s] > load.get(s, 0)]
    rows = rows.withColumn("k", F.col("rank") - _lookup(quota, F.col("shard"), 0) + _lookup(over, F.col("shard"), 0)).withColumn("moves", F.col("rank") >= _lookup(quota, F.col("shard"), 0))
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for s, n, places in free:
        here = (F.col("k") >= n) & (F.col("k") < n + places)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("k") - n + load.get(s, 0)).otherwise(slot)
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.when(F.col("moves"), to).otherwise(F.col("shard")).cast("int").alias("shard"), F.when(F.col("moves"), slot).otherwise(F.col("rank")).cast("bigint").alias("slot"), "whole")


def op8(spark, sf_dir: str) -> DataFrame:
    df = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "whole")
