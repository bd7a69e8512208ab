"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from tokenmill.llm import runs

KIND = "doc_id long, text string, key string, n_words string, runs string, fragments string"


def brute(words, least=12):
    """(start, length, period) by start and then period: longest stretches of equal words at a distance, with their smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - at >= q and end - at + q >= least:
                best.setdefault((at, end + q), q)
            at = max(end, at) + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def order(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def samples():
    rng = random.Random(3)
    morse = [bin(k).count("1") & 1 for k in range(300)]
    fib = ["a", "b"]
    for _ in range(10):
        fib.append(fib[-1] + fib[-2])
    out = [["x"] * 400, list(map(str, morse)), list(fib[-1]), [str(k) for k in range(300)], ["a"] * 11, ["a"] * 12, ["p", "q"] * 6, ["p", "q"] * 5 + ["p"], [], ["one"]]
    for _ in range(25):
        out.append([str(rng.randrange(rng.choice([2, 3]))) for _ in range(rng.randrange(12, 160))])
    for _ in range(25):
        words = [str(k) for k in range(rng.randrange(400))]
        for _ in range(rng.randrange(1, 4)):
            p, at = rng.randrange(1, 90), rng.randrange(len(words) + 1)
            block = [f"b{rng.randrange(5)}" if rng.random() < 0.3 else f"c{k}" for k in range(p)]
            words[at:at] = (block * rng.randrange(2, 14))[: rng.randrange(2 * p, 14 * p + 1)]
        out.append(words)
    return out


def test_against_brute_force(spark):
    texts = [" ".join(w) for w in samples()]
    rows = [(k, t, "k", "n", "r", "f") for k, t in enumerate(texts)]
    want = {k: brute(t.split()) for k, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 100
    for tile in (1, 16, runs.TILE):
        got = {r["doc_id"]: r for r in runs.periodic_runs(spark.createDataFrame(rows, KIND), tile=tile).collect()}
        assert sorted(got) == sorted(want)
        for k, found in want.items():
            assert [tuple(r) for r in got[k]["runs"]] == order(found)
            assert got[k]["collapsed"] == collapsed(texts[k].split(), found) and got[k]["n_words"] == len(texts[k].split())


def test_shorter_runs(spark):
    text = "a a b c b c b x y y y"
    got = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), least=3).first()
    assert [tuple(r) for r in got["runs"]] == [(2, 5, 2), (8, 3, 1)] == brute(text.split(), 3) and got["collapsed"] == "a a b c x y"


def test_nulls_repeats_and_white_space(spark):
    rows = [(1, None), (2, ""), (3, " \n\t \x0b"), (None, "a b " * 9), (4, "\na\tb " * 9), (4, "\na\tb " * 9), (5, "é漢 😀 x y " * 8), (6, "A a " * 8 + "z")]
    frame = spark.createDataFrame([(i, t, "k", "n", "r", "f") for i, t in rows], KIND)
    got = Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in runs.periodic_runs(frame).collect())
    assert got == Counter((i, len(words_of(t)), tuple(order(brute(words_of(t)))), collapsed(words_of(t), brute(words_of(t)))) for i, t in rows)
    assert runs.periodic_runs(frame.limit(0)).count() == 0


def test_very_long_text(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in rng.integers(0, 1 << 40, 1_050_000).tolist()]  # over 12 MB
    words[1000:160_000] = (words[1000:31_000] * 6)[:159_000]
    words[200_000:300_000] = ["same"] * 100_000
    words[400_000:560_000] = (words[400_000:480_000] * 2)
    got = runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(1000, 159_000, 30_000), (200_000, 100_000, 1), (400_000, 160_000, 80_000)]
    assert got["collapsed"] == " ".join(words[:31_000] + words[160_000:200_001] + words[300_000:480_000] + words[560_000:])


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, words_of(text))
    found = brute(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *most, digest("".join("%d,%d,%d\n" % r for r in order(found))), digest(collapsed(words, found)))


def test_query(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in given if len(r["text"] or "") < 8000] + [(None, "a b c " * 10), (7, None), (7, "")]
    rows += [(k, " ".join(map(str, range(k % 40)))) for k in range(10_000, 10_400)] + rows[:3]
    spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, g string").write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op13(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names and [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    want = Counter(expected(*r) for r in rows)
    assert sum(k[1] > 0 for k in want) > 40 and Counter(tuple(r) for r in got.collect()) == want
