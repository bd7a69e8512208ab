"""The pipeline's stages and run() against brute force, on repeated, missing and clashing ids, nulls and empty tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tokenmill.llm import jaccard, secrets, subwords
from tokenmill.llm.common import may_hold

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and house river hill dog when there which would people".split(), "de": "der und nicht haus katze schlafen ganzen wenn auch werden über straße".split()}
SECRET = "password=abcdef1234"


def table(spark, rows):
    frame = spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows], KIND)
    return frame.withColumns({c: F.lit("x") for c in ("key", "a", "b", "maybe", "goes", "first", "h", "k1", "c0", "n_hit")})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def groups(rows):
    """Rows joined by links of five-word shingles, as lists of places."""
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    out = {}
    for place, x in enumerate(label):
        out.setdefault(x, []).append(place)
    return list(out.values())


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def contaminated(t, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    fold = lambda s: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    own = fold(t)
    for item in map(fold, items):
        k = min(10, len(item))
        windows = {tuple(item[i:i + k]) for i in range(len(item) - k + 1)} if k else set()
        if any(tuple(own[i:i + k]) in windows for i in range(len(own) - k + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(9)
    rows = [(k, text(rng, lang, 40), lang, "s") for k, lang in enumerate(["en", "de"] * 60)]
    a, b, c = (text(rng, "en", 60) for _ in range(3))
    rows += [(1000, a, "en", "s"), (1001, a, "en", "s"), (1001, b, "en", "s"), (None, a, "en", "s"), (None, c, "en", "s")]
    rows += [(1002, c + " more", "en", "s"), (None, c + " more", "en", "t"), (1003, "x " + b, "en", "s")] + [(1004, text(rng, "de", 50), "de", "s")] * 3
    d = text(rng, "en", 50)
    rows += [(1005, d, "en", "s"), (1005, d, "en", "t"), (1005, d, None, "s"), (1006, None, "en", "s"), (1007, "", "en", "s"), (1008, "12 34 56", "en", "s")]
    leak = text(rng, "en", 14)
    rows += [(1009, text(rng, "en", 30) + " " + leak + " " + text(rng, "en", 30), "en", "s"), (1010, text(rng, "en", 30) + f" {SECRET} " + text(rng, "en", 20), "en", "s")]
    return rows, leak


def survivors(rows):
    """Texts and ids of one row for each group, and how many rows the group's first id has."""
    kept = Counter()
    for own in groups(rows):
        least = min(own, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        kept[rows[least][0]] += 1
    return kept


def test_survivors_by_row(spark):
    rng = random.Random(1)
    a, b, c = (text(rng, "en", 60) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, a), (None, c)]
    out = pipeline.drop_near_duplicates(spark, table(spark, [(i, t, "en", "s") for i, t in rows]), "")
    assert out.columns == pipeline.COLUMNS
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, a), (2, b), (None, c)])


def test_near_duplicate_stage(spark, samples):
    rows, _ = samples
    out = pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()
    assert len(out) == len(groups(rows)) and Counter(r["doc_id"] for r in out) == survivors(rows)
    given = {(i, t, lang, s) for i, t, lang, s in rows}
    assert all((r["doc_id"], r["text"], r["lang"], r["source"]) in given for r in out)


def test_run(spark, samples, tmp_path):
    rows, leak = samples
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, leak), (None, text(random.Random(2), "de", 20)), (2, ""), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = []
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, str(tmp_path))).collect(), out.schema)
        stages.append(docs.collect())
    first, second, third, fourth, last = stages
    # language: no null, empty or letterless text, nearly all others; a missing language is filled in
    assert all(r["text"] and re.search("[a-z]", r["text"]) and r["lang"] in ("en", "de") for r in first)
    assert len(first) >= 0.95 * sum(t is not None and re.search("[a-z]", t) is not None for _, t, *_ in rows)
    as_rows = lambda part: [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in part]
    assert len(second) == len(groups(as_rows(first))) and Counter(r["doc_id"] for r in second) == survivors(as_rows(first))
    assert Counter(as_rows(third)) == Counter(r for r in as_rows(second) if not contaminated(r[1], [t for _, t in items]))
    assert any(r["doc_id"] == 1009 for r in second) and not any(r["doc_id"] == 1009 for r in third)
    assert Counter(r["doc_id"] for r in fourth) == Counter(r["doc_id"] for r in third) and all(r["n_chars"] == len(r["text"]) for r in fourth)
    assert [SECRET in r["text"] for r in third if r["doc_id"] == 1010] == [True] and [SECRET in r["text"] for r in fourth if r["doc_id"] == 1010] == [False]
    clean = {r["text"] for r in third} - {r["text"] for r in fourth}
    assert len(clean) == 1 and len(secrets.scan_secrets(table(spark, [(1, clean.pop(), "en", "s")])).first()) > 1
    library = sentencepiece.SentencePieceProcessor(model_file=subwords.MODEL)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in fourth)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in last) == want and all(r["whole"] and r["n_ids"] == len(r["ids"]) for r in last)
    assert Counter((r["doc_id"], r["n_ids"]) for r in pipeline.run(spark, str(tmp_path)).collect()) == Counter((i, len(ids)) for (i, ids), n in want.items() for _ in range(n))


def test_stages_take_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    rows = [(k, f"{k} the house of {SECRET} and über " * (k % 7), "en", "s") for k in range(60)]
    try:
        spark.conf.set(setting, "10000")
        want = sorted(map(tuple, pipeline.encode_pieces(spark, table(spark, rows), "").collect()))
        got = pipeline.in_batches(pipeline.encode_pieces, 7)(spark, table(spark, rows).coalesce(1), "")
        assert sorted(map(tuple, got.collect())) == want

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        assert max(r["n"] for r in spark.range(60).coalesce(1).mapInArrow(sizes, "n long").collect()) == 7
        assert pipeline.STAGES[-1][1](spark, table(spark, rows), "").columns and spark.conf.get(setting) == str(pipeline.BATCH_ROWS)
    finally:
        spark.conf.set(setting, before)


def test_first_stages_take_small_batches(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    rows = [(k, f"the house of {k} and the river", "en", "s") for k in range(20)]
    try:
        for _, stage in pipeline.STAGES[:2]:
            spark.conf.set(setting, "10000")
            stage(spark, table(spark, rows), "")
            assert int(spark.conf.get(setting)) <= 1000
    finally:
        spark.conf.set(setting, before)


class Handed:
    """Stands for a frame and hands out the function that mapInArrow gets."""

    def __init__(self):
        self.schema, self.dataType, self.sparkSession, self.sparkContext = {"id": self}, self, self, self

    def simpleString(self):
        return "long"

    def broadcast(self, value):
        self.value = value
        return self

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


@pytest.mark.parametrize("rows", [2, 5, 20])
def test_join_blocks_span_batches(rows, monkeypatch):
    whole = pa.RecordBatch.from_pydict({"id": list(range(20)), "h": list(range(20)), "t": ["a b c d e f", "g h i j k l", None, "a b c d e f", ""] * 4})
    cuts = [whole.slice(0, 0), *(whole.slice(k, rows) for k in range(0, 20, rows)), whole.slice(0, 0)]

    def reports():
        out = [r for b in jaccard._classes(Handed(), 5)(iter(cuts)) for r in b.to_pylist()]
        assert [r["id"] for r in out] == list(range(20)) and [r["n"] for r in out] == [2, 2, 0, 2, 0] * 4
        return [sorted(r["held"]) for r in out if r["common"]]

    assert reports() == [[4, 4, 8, 8]]
    none = np.zeros(0, np.int64)
    met = [(r["token"], r["k"]) for b in jaccard._prefixes(Handed(), none.view(np.uint64), none, 5, (3, 4))(iter(cuts)) for r in b.to_pylist()]
    assert len(met) == len(set(met)) == 2
    if rows < 20:
        for limit, value in (("BLOCK_TOKENS", 12), ("BLOCK_ROWS", 10)):
            monkeypatch.setattr(jaccard, limit, value)
            assert reports() == [[4, 4]] * 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_key_map(spark):
    rng = random.Random(5)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame([(k,) for k in keys], "v long")
    some = rows.where("v % 2 = 0")
    got = {r["v"]: r["maybe"] for r in may_hold(rows, F.col("v"), some, F.col("v")).collect()}
    assert len(got) == len(keys) and all(got[k] for k in keys if k % 2 == 0) and sum(got.values()) <= sum(k % 2 == 0 for k in keys) + 2
    assert not any(r["maybe"] for r in may_hold(rows, F.col("v"), some.limit(0), F.col("v")).collect())


def test_sets_travel_as_pressed_texts():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "of", "Ärger", "thonea", "und", f"w{rng.randrange(300)}"]) for _ in range(400)) for _ in range(30)] + ["a  b", "", "x y z a b c"]
    sets = list(jaccard.Shingles(5)(pa.array(texts)))
    column = jaccard.text_column(pa.array(texts), sets)
    assert 2 * column.nbytes < 8 * sum(map(len, sets))
    order = rng.sample(range(len(texts)), len(texts))
    back = jaccard.sets_of(pa.chunked_array([column.slice(0, 7), column.slice(7)]), np.array(order), 5)
    assert all(np.array_equal(own, sets[k]) for own, k in zip(back, order, strict=True))
