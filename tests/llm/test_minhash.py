"""MinHash near-duplicates against brute force over all pairs of sets."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tokenmill.llm import minhash
from tokenmill.llm.jaccard import Shingles

KIND = "doc_id long, text string, k string, n string, signature string, h string"


def shingles(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id, kept, n_links) with counts."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    common = Counter(pair for own in holders.values() for pair in combinations(own, 2))
    linked = {i: set() for i in range(len(rows))}
    for (i, j), c in common.items():
        if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
            linked[i].add(j)
            linked[j].add(i)
    want = Counter()
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        want[doc, len(sets[i]), least, doc == least, len(linked[i])] += 1
    return want


def found(spark, rows):
    frame = spark.createDataFrame([(i, t, "k", "n", "s", "h") for i, t in rows], KIND)
    return Counter(tuple(r) for r in minhash.near_duplicates(frame).select("doc_id", "n_shingles", "component_id", "kept", "n_links").collect())


def near_copies():
    rng = random.Random(4)
    rows = []
    for size in (8, 20, 60, 200, 900):
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(8):
                own = list(base)
                for _ in range(rng.randrange(0, max(2, size // 20))):
                    own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                rows.append(" ".join(own))
    base = [f"v{k}" for k in range(300)]  # a list of over 64 near copies, and a chain of drifting ones
    rows += [" ".join(base[:k] + [f"y{k}"] + base[k + 1:]) for k in range(120)]
    rows += [" ".join(f"z{j}" for j in range(4 * k, 4 * k + 120)) for k in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = near_copies()
    want = brute(rows)
    assert 60 < sum(k[3] for k in want) < len(rows) - 100
    assert found(spark, rows) == want


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (6, "one"), (None, text), (9, text + " more"), (8, text), (None, "a b c d e"), (None, "a b c d e"), (10, "a b c d e f")]
    rows.append((11, " ".join(f"u{k % 70_000}" for k in range(400_000))))  # long texts of repeated words
    rows.append((12, " ".join(f"u{k % 70_000}" for k in range(350_000)) + " end"))
    assert found(spark, rows) == brute(rows)
    assert not found(spark, [])


def test_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = minhash.op11(spark, "/root/testdata/sf0.001")
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("values, share", [(128, (85, 100)), (64, (3, 4))])
def test_pigeonhole(values, share):
    distance = minhash.allowed_distance(values, share, 1e-7)
    edges = minhash.chunk_edges(values, distance)
    assert edges[0] == 0 and edges[-1] == values and (np.diff(edges) > 1).all()
    assert distance // (len(edges) - 1) <= minhash.ERRORS


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(6)
    distance = minhash.allowed_distance(minhash.VALUES, minhash.SHARE, minhash.MISSED)
    edges = minhash.chunk_edges(minhash.VALUES, distance)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, minhash.VALUES).astype(np.uint16)
        b = a.copy()
        at = rng.choice(minhash.VALUES, distance, replace=False)
        b[at] ^= rng.integers(1, 1 << 16, distance).astype(np.uint16)
        x, y = minhash.error_keys(np.stack([a, b]), edges)
        assert (x == y).any()
    # differences dealt as evenly as the chunks allow leave just one key
    b = a.copy()
    b[np.concatenate([edges[:-1], edges[1:-1] + 1])[:distance]] += np.uint16(1)
    x, y = minhash.error_keys(np.stack([a, b]), edges)
    assert (x == y).sum() == 1
    assert not (minhash.error_keys(np.stack([a, rng.permutation(a)]), edges)[0] == minhash.error_keys(np.stack([rng.permutation(a)]), edges)[0]).any()


def test_signatures_follow_similarity():
    rng = np.random.default_rng(7)
    differing = []
    for _ in range(60):
        tokens = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.int64)).astype(np.uint64)
        a, b = minhash.signatures([np.sort(tokens[:925]), np.sort(tokens[75:])])
        differing.append((a != b).sum())
    assert abs(np.mean(differing) / minhash.VALUES - 150 / 1000) < 0.01
    big = np.sort(np.unique(rng.integers(0, 1 << 63, 100_000, dtype=np.int64)).astype(np.uint64))
    assert (minhash.signatures([big])[0] == minhash.signatures([big[::2], big[1::2], big])[2]).all()
    assert len(list(Shingles(3)(__import__("pyarrow").array(["a b c d"])))[0]) == 2
