"""Splits, draws, mixes and batch plans over `documents`."""

import uuid

from pyspark.sql import functions as F

from tokenmill.functions.hashing import hash_uniform
from tokenmill.operators import sampling as S
from tokenmill.operators.prefix import position, running_total, shuffled_position
from tokenmill.operators.rangejoin import range_join
from tokenmill.plans.registry import query
from tokenmill.plans.sqltext import h_below, h_hex, h_int, h_uniform
from tokenmill.session import shared_dir

SHUFFLED = "shuffled AS (SELECT *, row_number() OVER (ORDER BY {}, doc_id) - 1 AS pos FROM documents)"


@query(
    "smp01_split",
    f"""WITH {SHUFFLED.format(h_hex(1234, "doc_id"))}, n AS (SELECT count(*) AS n FROM documents),
    sizes AS (SELECT n, floor(n * 0.9::DOUBLE)::BIGINT AS a, n * 0.9::DOUBLE - floor(n * 0.9::DOUBLE) AS ra, n * 0.06::DOUBLE AS eb FROM n),
    s2 AS (SELECT *, floor(floor(eb) + ra + (eb - floor(eb)))::BIGINT AS b FROM sizes)
    SELECT doc_id, pos, CASE WHEN pos < a THEN 'train' WHEN pos < a + b THEN 'valid' ELSE 'test' END AS split FROM shuffled, s2""",
)
def _(t):
    shares = S.parse_split("90,6,4")
    return S.split_rows(t.documents.select("doc_id"), ["doc_id"], shares)


@query("smp03_global_shuffle", f"WITH {SHUFFLED.format(h_hex('epoch-0', 'doc_id'))} SELECT doc_id, pos FROM shuffled")
def _(t):
    return shuffled_position(t.documents.select("doc_id"), "epoch-0", ["doc_id"])


@query(
    "smp04_scatter",
    f"WITH {SHUFFLED.format(h_hex('scatter', 'doc_id'))}, n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, pos, pos // ((n + 31) // 32) AS shard FROM shuffled, n",
)
def _(t):
    return S.scatter(t.documents.select("doc_id"), ["doc_id"], 32)


@query("smp05_saved_order", f"WITH {SHUFFLED.format(h_hex('saved', 'doc_id'))} SELECT doc_id, lang, pos FROM shuffled")
def _(t):
    path = f"{shared_dir(t.spark)}/order-{uuid.uuid4().hex}"
    S.save_order(t.documents, ["doc_id"], "saved", path)
    return S.load_order(t.documents.select("doc_id", "lang"), ["doc_id"], path)


OWNED = """owned AS (SELECT doc_id, length(text) AS len, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS lo,
  sum(length(text)) OVER (ORDER BY doc_id) AS hi FROM documents), total AS (SELECT sum(length(text))::BIGINT AS total FROM documents)"""


@query(
    "smp06_weighted_draws",
    f"""WITH {OWNED}, points AS (SELECT doc_id AS draw, {h_below("total", "weighted", "doc_id")} AS point FROM documents, total)
    SELECT draw, point, o.doc_id, lo::BIGINT AS lo, hi::BIGINT AS hi FROM points JOIN owned o ON point >= lo AND point < hi""",
)
def _(t):
    line = S.weight_line(t.documents, "doc_id", F.length("text"))
    return S.weighted_draws(t.documents.select(F.col("doc_id").alias("draw")), ["draw"], line, "weighted", 16384)


@query(
    "smp06_weighted_draw_counts",
    f"""WITH {OWNED}, points AS (SELECT doc_id AS draw, rep, {h_below("total", "weighted", "doc_id", "rep")} AS point FROM documents, range(20) r(rep), total)
    SELECT o.doc_id, count(*) AS n FROM points JOIN owned o ON point >= lo AND point < hi GROUP BY o.doc_id""",
)
def _(t):
    line = S.weight_line(t.documents, "doc_id", F.length("text"))
    draws = t.documents.select(F.col("doc_id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("rep"))
    return S.weighted_draws(draws, ["draw", "rep"], line, "weighted", 16384).groupBy("doc_id").agg(F.count("*").alias("n"))


POSITIONED = "positioned AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), n AS (SELECT count(*) AS n FROM documents)"


@query(
    "smp07_uniform_draws",
    f"WITH {POSITIONED}, draws AS (SELECT doc_id AS draw, {h_below('n', 'uniform', 'doc_id')} AS pos FROM documents, n) SELECT draw, pos, doc_id, lang FROM draws JOIN positioned USING (pos)",
)
def _(t):
    draws = t.documents.select(F.col("doc_id").alias("draw"))
    return S.uniform_draws(draws, ["draw"], t.documents.select("doc_id", "lang"), "doc_id", "uniform")


@query("smp07_permutation", f"WITH {SHUFFLED.format(h_hex('epoch-3', 'doc_id'))} SELECT pos, doc_id FROM shuffled")
def _(t):
    return shuffled_position(t.documents.select("doc_id"), "epoch-3", ["doc_id"])


@query(
    "smp08_source_keep_share",
    f"SELECT source, count(*) AS n FROM documents WHERE {h_uniform('keep', 'doc_id')} < CASE source WHEN 'src1' THEN 0.3 WHEN 'src2' THEN 0.5 ELSE 1.0 END GROUP BY source",
)
def _(t):
    share = F.when(F.col("source") == "src1", 0.3).when(F.col("source") == "src2", 0.5).otherwise(1.0)
    return t.documents.filter(hash_uniform("keep", "doc_id") < share).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "smp09_task_mix",
    f"""WITH sizes AS (SELECT lang, count(*) AS n, pow(least(count(*), 200000)::DOUBLE, 0.8::DOUBLE) AS weight FROM documents GROUP BY lang),
    line AS (SELECT *, sum(weight) OVER (ORDER BY lang) AS hi FROM sizes), line2 AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY lang), 0) AS lo FROM line),
    total AS (SELECT max(hi) AS total FROM line),
    draws AS (SELECT doc_id AS draw, {h_uniform("mix-task", "doc_id")} * total AS u, {h_int("mix-row", "doc_id")} AS h FROM documents, total),
    chosen AS (SELECT draw, lang, h % n AS pos FROM draws JOIN line2 ON lo <= u AND u < hi),
    positioned AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)
    SELECT draw, lang, pos, doc_id FROM chosen JOIN positioned USING (lang, pos)""",
)
def _(t):
    draws = t.documents.select(F.col("doc_id").alias("draw"))
    return S.mixed_task_draws(draws, "draw", t.documents.select("doc_id", "lang"), "lang", "doc_id", "mix")


@query(
    "smp09_task_weights",
    """SELECT lang, count(*) AS n, round(pow(least(count(*), 200)::DOUBLE, 0.8::DOUBLE), 6) AS weight FROM documents GROUP BY lang""",
)
def _(t):
    return S.task_weights(t.documents.select("lang"), "lang", max_limit=200).select("lang", "n", F.round("weight", 6).alias("weight"))


@query("smp10_first_two_thirds", f"WITH {POSITIONED} SELECT doc_id, pos FROM positioned, n WHERE pos < 2 * n // 3")
def _(t):
    return S.first_share(t.documents.select("doc_id"), "doc_id")


@query(
    "smp11_pretraining_mix",
    f"""WITH tagged AS (SELECT event_id AS step, CASE WHEN {h_uniform("steps", "event_id")} < 0.25 THEN 'multi-task' ELSE 'block' END AS stream FROM events)
    SELECT step, stream, row_number() OVER (PARTITION BY stream ORDER BY step) - 1 AS batch_no FROM tagged""",
)
def _(t):
    return S.pretraining_mix(t.events.select(F.col("event_id").alias("step")), "step", 0.25, "steps")


@query(
    "smp11_finetuning_mix",
    f"""WITH tagged AS (SELECT event_id AS step, CASE WHEN {h_uniform("fine", "event_id")} > 1.0::DOUBLE / 1.5::DOUBLE THEN 'block' ELSE 'finetune' END AS stream FROM events)
    SELECT step, stream, row_number() OVER (PARTITION BY stream ORDER BY step) - 1 AS batch_no FROM tagged""",
)
def _(t):
    return S.finetuning_mix(t.events.select(F.col("event_id").alias("step")), "step", 0.5, "fine")


@query(
    "smp12_batch_plan",
    f"""WITH {POSITIONED} SELECT doc_id, pos, pos // 24 AS batch, pos % 24 AS slot, ((pos % 24 + 1) * 5 - 1) // 24 AS consumer
    FROM positioned, n WHERE pos < n // 24 * 24 AND pos // 24 >= 3""",
)
def _(t):
    return S.batch_plan(t.documents.select("doc_id"), "doc_id", 24, 5, drop_last=True, start_batch=3)


@query(
    "smp13_strided_plan",
    f"""WITH {POSITIONED} SELECT p.pos AS step, lane::INTEGER AS lane, (p.pos + lane * (n // 8)) % n AS pos FROM positioned p, n, range(8) l(lane)""",
)
def _(t):
    steps = position(t.documents.select("doc_id"), "doc_id", "step").select("step")
    total = t.documents.agg(F.count("*").alias("n"))
    return S.strided_plan(steps.crossJoin(F.broadcast(total)), "step", F.col("n"), 8).select("step", "lane", "pos")


@query(
    "smp14_order_by_choices",
    "SELECT doc_id, choices, row_number() OVER (ORDER BY choices, doc_id) - 1 AS pos FROM (SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS choices FROM documents)",
)
def _(t):
    examples = t.documents.select("doc_id", F.size(F.split("text", "\n")).alias("choices"))
    return S.order_by_choices(examples, "choices", "doc_id")


@query("win01_running_total", "SELECT doc_id, (sum(length(text)) OVER (ORDER BY doc_id) - length(text))::BIGINT AS before FROM documents")
def _(t):
    docs = t.documents.select("doc_id", F.length("text").alias("len"))
    return running_total(docs, "doc_id", F.col("len")).drop("len")


@query(
    "win02_rank_in_shuffled_order",
    f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {h_hex('rank', 'doc_id')}, doc_id) - 1 AS pos FROM documents",
)
def _(t):
    return shuffled_position(t.documents.select("doc_id", "lang"), "rank", ["doc_id"], within=["lang"])


@query(
    "jon03_range_join",
    """WITH owned AS (SELECT o_orderkey, sum(o_totalprice::BIGINT) OVER w - o_totalprice::BIGINT AS lo, sum(o_totalprice::BIGINT) OVER w AS hi
      FROM (SELECT o_orderkey, floor(o_totalprice / 1000) AS o_totalprice FROM orders) WINDOW w AS (ORDER BY o_orderkey))
    SELECT e.event_id, o_orderkey FROM events e JOIN owned ON e.event_id >= lo AND e.event_id < hi""",
)
def _(t):
    owned = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("w"))
    owned = running_total(owned, "o_orderkey", F.col("w"), "lo").withColumn("hi", F.col("lo") + F.col("w"))
    return range_join(t.events.select("event_id"), "event_id", owned, "lo", "hi", 1024).select("event_id", "o_orderkey")


@query(
    "jon08_random_partner",
    f"""WITH {POSITIONED}, picks AS (SELECT doc_id, pos, {h_below("n - 1", "partner", "doc_id")} AS r FROM positioned, n)
    SELECT p.doc_id, q.doc_id AS partner_id FROM picks p JOIN positioned q ON q.pos = p.r + CASE WHEN p.r >= p.pos THEN 1 ELSE 0 END""",
)
def _(t):
    docs = t.documents.select("doc_id")
    others = position(docs, "doc_id", "partner_pos").withColumnRenamed("doc_id", "partner_id")
    return S.partner_positions(docs, "doc_id", "partner").join(others, "partner_pos").select("doc_id", "partner_id")


@query(
    "srt04_preview",
    f"""WITH {POSITIONED}, picks AS (SELECT i::INTEGER AS i, {h_below("n", "preview", "i")} AS pos FROM range(5) r(i), n)
    SELECT 'first' AS part, pos::INTEGER AS i, doc_id FROM positioned WHERE pos < 5
    UNION ALL SELECT 'random', i, doc_id FROM picks JOIN positioned USING (pos)""",
)
def _(t):
    docs = t.documents.select("doc_id")
    first = docs.orderBy("doc_id").limit(5)  # a preview of five rows is the feature
    first = position(first, "doc_id", "i").select(F.lit("first").alias("part"), F.col("i").cast("int"), "doc_id")
    draws = t.spark.range(5).select(F.col("id").cast("int").alias("i"))
    random = S.uniform_draws(draws, ["i"], docs, "doc_id", "preview").select(F.lit("random").alias("part"), "i", "doc_id")
    return first.unionByName(random)
