"""Sequence operators against step-by-step models on small documents."""

import random
from bisect import bisect_right
from itertools import accumulate

import pytest
from draws import below, uniform
from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions.hashing import hash_uniform, heads
from tokenmill.operators import sequences as S
from tokenmill.operators.vocab import encode_chars

EOS, CLS, PAD, END = 900, 901, 902, 7
SCHEMA = "doc_id long, tokens array<int>, loss_mask array<int>"


def documents(lengths):
    """Documents whose tokens tell where they stand; every fifth token ends a sentence."""
    docs = []
    for i, n in enumerate(lengths):
        tokens = [END if j % 5 == 4 else 10 + (i * 37 + j) % 500 for j in range(n)]
        docs.append((i, tokens, [0] * (n // 3) + [1] * (n - n // 3)))
    return docs


def test_chunks_move_no_whole_documents(spark):
    docs = spark.createDataFrame(documents([5000, 3]), SCHEMA)
    lines = S.contiguous_chunks(docs, "doc_id", 7, EOS, PAD)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    moved = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(doc_id" in line:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            moved.append(("tokens" in "".join(lines[i:below]), "Generate explode(" in "".join(lines[i:below])))
    assert (True, True) in moved and (True, False) not in moved  # what holds tokens has been cut before it moves


@pytest.mark.parametrize("lengths", [[3, 0, 20, 5], [7, 7], [1], [100, 2, 2]])
def test_contiguous_chunks(spark, lengths):
    docs, size = documents(lengths), 7
    rows = {r["chunk"]: r for r in S.contiguous_chunks(spark.createDataFrame(docs, SCHEMA), "doc_id", size, EOS, PAD, mem_len=4).collect()}
    flat = [(t, (ts + [EOS])[j + 1], (ls + [1])[j + 1], j) for _, ts, ls in docs for j, t in enumerate(ts)]
    assert sorted(rows) == list(range(len(flat) // size + 1))
    for c, row in rows.items():
        part = flat[c * size : (c + 1) * size]
        fill = size - len(part)
        assert row["tokens"] == [x[0] for x in part] + [PAD] * fill
        assert row["target"] == [x[1] for x in part] + [PAD] * fill
        assert row["loss"] == [x[2] for x in part] + [0] * fill
        assert row["history"] == (min(4, part[0][3]) if part else 0)


def drawn(docs, total_line, seed, sample, k):
    return docs[bisect_right(total_line, below(total_line[-1], seed, sample, k))]


@pytest.mark.parametrize("lengths", [[2, 3, 60, 1, 9], [120, 5, 40, 3, 72]])
def test_packed_sequences(spark, monkeypatch, lengths):
    monkeypatch.setattr(S, "PIECE_TOKENS", 8)
    docs, size, n = documents(lengths), 40, 60
    line = list(accumulate(len(d[1]) for d in docs))
    samples = spark.range(n).withColumnRenamed("id", "sample")
    rows = S.packed_sequences(samples, "sample", spark.createDataFrame(docs, SCHEMA), "doc_id", size, EOS, PAD, "s", width=4).collect()
    assert len(rows) == n
    for row in rows:
        _, tokens, loss = drawn(docs, line, "s", row["sample"], 0)
        tokens, loss = tokens + [EOS], loss + [1]
        if len(tokens) > size + 1:
            start = below(len(tokens) - size, "s-start", row["sample"])
            tokens, loss = tokens[start:], loss[start:]
        k = 1
        while len(tokens) < size + 1:
            _, more, more_loss = drawn(docs, line, "s", row["sample"], k)
            tokens, loss, k = tokens + more + [EOS], loss + more_loss + [1], k + 1
        assert row["tokens"] == tokens[: size + 1]
        assert row["loss_mask"] == loss[: size + 1]


def right_strip(tokens, loss, limit):
    strip = len(tokens) - limit
    if strip > 0:
        while strip < len(tokens) - 1 and tokens[-strip - 1] != END:
            strip += 1
        if len(tokens) - strip < limit // 2:
            strip = len(tokens) - limit
        tokens, loss = tokens[:-strip], loss[:-strip]
    return tokens, loss


@pytest.mark.parametrize("non_start", [0.0, 0.5])
def test_block_samples(spark, monkeypatch, non_start):
    monkeypatch.setattr(S, "PIECE_TOKENS", 8)
    docs, size, n = documents([2, 3, 90, 1, 9, 31, 45]), 32, 80
    line = list(accumulate(len(d[1]) for d in docs))
    samples = spark.range(n).withColumnRenamed("id", "sample")
    df = S.block_samples(samples, "sample", spark.createDataFrame(docs, SCHEMA), "doc_id", size, CLS, EOS, [END], "b", non_start, width=4)
    rows = df.collect()
    assert len(rows) == n
    for row in rows:
        s = row["sample"]
        _, tokens, loss = drawn(docs, line, "b", s, 0)
        tokens, loss = tokens + [EOS], loss + [1]
        surplus = len(tokens) - size + 1
        if surplus > 0:
            start, moves = below(surplus, "b-start", s), 0
            if uniform("b-move", s) > non_start:
                if uniform("b-side", s) < 0.5:
                    while moves < size // 2 and start > 0 and tokens[start - 1] != END:
                        start, moves = start - 1, moves + 1
                else:
                    while moves < size // 2 and start < len(tokens) and tokens[start - 1] != END:
                        start, moves = start + 1, moves + 1
            tokens, loss = [CLS] + tokens[start:], [0] + loss[start:]
            if len(tokens) == 2 and tokens[1] == EOS:
                tokens, loss = [], []
            tokens, loss = right_strip(tokens, loss, size)
        else:
            tokens, loss, k = [CLS] + tokens, [0] + loss, 1
            while len(tokens) < size:
                _, more, more_loss = drawn(docs, line, "b", s, k)
                more, more_loss, k = [CLS] + more + [EOS], [0] + more_loss + [1], k + 1
                last = len(more) >= size - len(tokens)
                more, more_loss = right_strip(more, more_loss, size - len(tokens))
                tokens, loss = tokens + more, loss + more_loss
                if last:
                    break
        assert row["tokens"] == tokens, s
        assert row["loss_mask"] == loss


def test_sentence_pairs(spark):
    docs = [(i, 1 + i, [[100 * i + 10 * j + k for k in range(1 + (i + j) % 4)] for j in range(1 + i % 6)]) for i in range(20)]
    where = {t: (i, j) for i, _, ss in docs for j, s in enumerate(ss) for t in s}
    frame = spark.createDataFrame(docs, "doc_id long, weight long, sentences array<array<int>>")
    rows = S.sentence_pairs(spark.range(150).withColumnRenamed("id", "sample"), "sample", frame, "doc_id", 12, "p", 0.2, width=8).collect()
    assert sorted(r["sample"] for r in rows) == list(range(150))
    kinds = {r["is_random"] for r in rows}
    for r in rows:
        assert r["tokens_a"] and r["tokens_b"]
        doc_a, last = where[r["tokens_a"][-1]]
        doc_b, first = where[r["tokens_b"][0]]
        assert {where[t][0] for t in r["tokens_a"]} == {doc_a} and {where[t][0] for t in r["tokens_b"]} == {doc_b}
        assert doc_a != doc_b if r["is_random"] else (doc_a, last + 1) == (doc_b, first)
    assert kinds == {True, False}


def test_sentence_pairs_end(spark):
    kind = "doc_id long, weight long, sentences array<array<int>>"
    samples = spark.range(40).withColumnRenamed("id", "sample")
    for sentences, length in (([[1, 2]], 12), ([[1, 2], []], 12), ([list(range(20)), [1] * 30, [1]], 12)):
        with pytest.raises(ValueError):
            S.sentence_pairs(samples, "sample", spark.createDataFrame([(1, 1, sentences)], kind), "doc_id", length, "p", width=8)
    # one document with a single good start among many: no number of tries ends the search
    long = [[10 * k + j for j in range(9)] for k in range(700)]
    long[400] = [4000]
    rows = S.sentence_pairs(samples, "sample", spark.createDataFrame([(1, 1, long)], kind), "doc_id", 9, "p", short_prob=0, width=64).collect()
    assert len(rows) == 40 and all(r["tokens_a"] == [4000] and r["tokens_b"] == long[401] and not r["is_random"] for r in rows)


def test_sentence_pairs_follow_their_definition(spark):
    """Against whole documents step by step; one document holds half of the corpus and reaches over many pieces."""
    rng = random.Random(8)
    sizes = [1500] + [rng.randrange(1, 12) for _ in range(200)]
    docs, token = [], 0
    for d, m in enumerate(sizes):
        sentences = []
        for _ in range(m):
            n = rng.choice([0, 1, 3, 3, 8, 30])
            sentences.append(list(range(token, token + n)))
            token += n
        docs.append((d, 1 + sum(map(len, sentences)), sentences))
    where = {t: (d, j) for d, _, ss in docs for j, s in enumerate(ss) for t in s}
    full = {d: [s for s in ss if s] for d, _, ss in docs}
    frame = spark.createDataFrame(docs, "doc_id long, weight long, sentences array<array<int>>")
    rows = S.sentence_pairs(spark.range(400).withColumnRenamed("id", "sample"), "sample", frame, "doc_id", 40, "p", 0.2, width=50).collect()
    assert sorted(r["sample"] for r in rows) == list(range(400))
    big = 0
    for r in rows:
        target = 2 + below(39, "p-length", r["sample"]) if uniform("p-short", r["sample"]) < 0.2 else 40
        a, b = r["tokens_a"], r["tokens_b"]
        ss = full[where[a[0]][0]]
        start = next(j for j, s in enumerate(ss) if s[0] == a[0])
        taken, total = 0, 0
        while start + taken < len(ss) and (taken == 0 or total < target):
            total += len(ss[start + taken])
            taken += 1
        num_a = next(n for n in range(1, taken + 1) if sum(ss[start:start + n], []) == a)
        if r["is_random"]:
            assert where[b[0]][0] != where[a[0]][0]
            other = full[where[b[0]][0]]
            first = next(j for j, s in enumerate(other) if s[0] == b[0])
            count, total = 0, 0
            while first + count < len(other) and (count == 0 or total < target - len(a)):
                total += len(other[first + count])
                count += 1
            assert b == sum(other[first:first + count], [])
        else:
            assert b == sum(ss[start + num_a:start + taken], [])
        big += where[a[0]][0] == 0
    assert 100 < big < 300


def test_truncate_pair_matches_one_by_one(spark):
    rows = [(a * 20 + b, list(range(a)), list(range(100, 100 + b))) for a in range(14) for b in range(14)]
    df = S.truncate_pair(spark.createDataFrame(rows, "k int, tokens_a array<int>, tokens_b array<int>"), "k", 9, "t")
    for r in df.collect():
        a, b = r["k"] // 20, r["k"] % 20
        while a + b > 9:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        assert (len(r["tokens_a"]), len(r["tokens_b"])) == (a, b)
        assert r["tokens_a"] == list(range(r["tokens_a"][0], r["tokens_a"][0] + a)) if a else True


def test_truncate_pair_of_texts(spark):
    rows = [(k if k else None, "aé€𝄞b" * k, "\n x" * (40 - k)) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, tokens_a string, tokens_b string")
    texts = S.truncate_pair(df, "k", 9, "t", size=F.length, take=lambda text, start, count: text.substr(start + 1, count))
    chars = df.withColumns({c: F.filter(F.split(c, ""), lambda x: x != "") for c in ("tokens_a", "tokens_b")})
    want = {r["k"]: ("".join(r["tokens_a"]), "".join(r["tokens_b"])) for r in S.truncate_pair(chars, "k", 9, "t").collect()}
    assert {r["k"]: (r["tokens_a"], r["tokens_b"]) for r in texts.collect()} == want


def test_heads(spark):
    df = spark.createDataFrame([(7, 500), (None, 500), (8, 0)], "k long, n int")
    coins = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: (hash_uniform("s", "k", i) < 0.5).cast("int"))
    for r in df.select("n", heads(F.col("n"), "s", "k").alias("got"), F.aggregate(coins, F.lit(0), lambda a, x: a + x).alias("want")).collect():
        assert r["got"] == (r["want"] if r["n"] else 0)


@pytest.mark.parametrize(("size", "windows"), [(0, 1), (5, 1), (8, 1), (9, 2), (11, 2), (12, 3)])
def test_window_counts(spark, size, windows):
    df = spark.createDataFrame([(1, list(range(1, size + 1)))], "d int, tokens array<int>")
    rows = sorted(S.sliding_windows(df, ["d"], 8, 3).collect(), key=lambda r: r["window"])
    assert len(rows) == windows
    scored = [t for r in rows for t, m in zip(r["tokens"], r["loss_mask"]) if m]
    assert set(range(1, min(size, 8) + 1)) <= set(scored)


def test_windows_in_form(spark):
    df = spark.createDataFrame([(n, list(range(1, n + 1))) for n in (0, 5, 8, 9, 12, 40)], "d int, tokens array<int>")
    plain = {(r["d"], r["window"]): (r["tokens"], r["loss_mask"]) for r in S.sliding_windows(df, ["d"], 8, 3).collect()}
    for (n, w), (tokens, mask) in plain.items():
        own = list(range(1, n + 1))[3 * w:3 * w + 8]
        assert tokens == own + [0] * (8 - len(own)) and mask == [int(i < len(own) and (w == 0 or i >= 5)) for i in range(8)]
    written = S.sliding_windows(df.withColumn("tokens", F.col("tokens").cast("array<string>")), ["d"], 8, 3, pad="0", form=lambda a: F.array_join(a, " "))
    assert "transform(" not in written._jdf.queryExecution().optimizedPlan().toString()  # nothing of a window is interpreted
    assert {(r["d"], r["window"]): (r["tokens"], r["loss_mask"]) for r in written.collect()} == {k: tuple(" ".join(map(str, a)) for a in v) for k, v in plain.items()}


def test_passage_windows_skip_does_not_stop(spark):
    context = "x" * 25 + "ans" + "x" * 12
    df = spark.createDataFrame([(1, context, 0, "ans")], "d int, context string, question_size int, answer string")
    rows = S.passage_windows(df, ["d"], 23, answer_required=True).collect()
    assert [r["start"] for r in rows] == [11, 22]
    assert [r["label"] for r in S.passage_windows(df, ["d"], 23).collect()] == ["N/A", "ans", "ans"]


def test_sections(spark):
    lines = [["Head"], ["One."], ["A.", "B."], ["lonely"], ["C.", "D.", "E."], ["H2"], ["x"], ["y"]]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "d int, line_no int, sentences array<string>")
    rows = sorted((r["section"], r["key_sentence"], r["content"]) for r in S.sections(df, "d").collect())
    assert [(k, c) for _, k, c in rows] == [("Head", "One."), ("A.", "B. lonely"), ("C.", "D. E."), ("H2", "x y")]


def test_segments(spark):
    df = spark.createDataFrame([([1, 9, 9, 2, 3, 9],), ([9],), ([],)], "t array<int>").select(S.segments(F.col("t"), 9).alias("s"))
    got = [[(x["segment"], x["position"]) for x in r["s"]] for r in df.collect()]
    assert got == [[(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (2, 2)], [(0, 0)], []]


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 2, 1, 2, 1],)], "a array<int>")
    a = F.col("a")
    row = df.select(
        A.first_index(a, 2).alias("f"), A.last_index(a, 2).alias("l"), A.last_index(a, 5).alias("n"),
        A.sublist_positions(a, F.array(F.lit(1), F.lit(2))).alias("p"), A.running_sums(a).alias("r"),
        A.tail(a, 2).alias("t"), A.fit(a, 7, 0).alias("fit"), A.fit(a, 3, 0).alias("cut"),
    ).first()
    assert (row["f"], row["l"], row["n"], row["p"], row["r"]) == (1, 3, -1, [0, 2], [1, 3, 4, 6, 7])
    assert (row["t"], row["fit"], row["cut"]) == ([2, 1], [1, 2, 1, 2, 1, 0, 0], [1, 2, 1])


@pytest.mark.parametrize("lengths", [[3, 0, 20, 5], [7], [], [100, 2, 2, 40], [0]])
@pytest.mark.parametrize("stride", [1, 3, 8])
def test_windows_over_the_stream(spark, lengths, stride):
    docs = documents(lengths)
    flat = [t for _, ts, _ in docs for t in ts]
    rows = {r["window"]: (r["tokens"], r["loss_mask"]) for r in S.stream_windows(spark.createDataFrame(docs, SCHEMA), "doc_id", 8, stride, PAD).collect()}
    want = {}
    for w in range(-(-max(len(flat) - 8, 0) // stride) + 1 if flat else 0):
        own = flat[w * stride:w * stride + 8]
        want[w] = (own + [PAD] * (8 - len(own)), [int(i < len(own) and (w == 0 or i >= 8 - stride)) for i in range(8)])
    assert rows == want


def test_documents_are_encoded_once_for_their_pieces(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "d" * 9)], "doc_id long, text string")
    pieces = S._sentence_pieces(docs.select("doc_id", F.transform(F.split("text", "c"), lambda s: F.split(s, "")).alias("sentences")), "doc_id")
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    assert [r["doc_id"] for r in pieces.where("sentences is null").collect()] == []


def test_last_token_of_texts_without_tokens(spark):
    docs = spark.createDataFrame([(0, [3, 4, 5]), (1, [7]), (2, []), (3, None)], "doc_id long, tokens array<int>")
    rows = docs.orderBy("doc_id").select(S.last_token_cloze(F.col("tokens")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in rows] == [([3, 4], 5), ([], 7), ([], None), (None, None)]


def test_sentences_are_made_twice(spark):
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    kind = "doc_id long, weight long, sentences array<array<int>>"
    docs = spark.createDataFrame([(i, 9 + i, [[1, 2, 3]] * (4 + i % 3)) for i in range(20)], kind)
    sentences = docs.select("doc_id", "sentences").repartition(1).mapInPandas(count, "doc_id long, sentences array<array<int>>")
    index = S.SentenceIndex(sentences, "doc_id")
    ranges = spark.createDataFrame([(i, i, 0, 1, 0, 0) for i in range(20)], "k long, doc_id long, from long, to long, lo long, hi long")
    ranges = ranges.join(index.documents().select("doc_id", "first"), "doc_id").select("k", "doc_id", "from", "to", F.col("first").alias("lo"), (F.col("first") + 5).alias("hi"))
    assert made.value == 20  # for the sizes; their sums and joins read what is written down
    assert [tuple(r) for r in index.tokens(ranges, ["k"]).orderBy("k").collect()] == [(i, [1, 2, 3, 1, 2]) for i in range(20)]
    assert made.value == 40


def test_texts_as_tokens(spark):
    """Characters in place of ids: the same chunks and windows, also beyond one plane, and a token moves about once however many windows it is in."""
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab\n é𝄞썐") for _ in range(n)) if n is not None else None) for i, n in enumerate([40, 0, 7, 1, None, 3000, 14])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cut = F.least(F.lit(3), F.length("text"))
    prompt, text = F.col("text").substr(F.lit(1), cut), F.col("text").substr(cut + 1, F.length("text"))
    as_ids = docs.select("doc_id", S.from_prompt(encode_chars(prompt), encode_chars(text)).alias("i")).select("doc_id", "i.*")
    as_text = docs.select("doc_id", S.from_prompt(prompt, text, F.length, S.digits).alias("i")).select("doc_id", "i.*")
    for make in (lambda d, **how: S.contiguous_chunks(d, "doc_id", 16, EOS, PAD, **how), lambda d, **how: S.stream_windows(d, "doc_id", 16, 4, **how)):
        assert sorted(make(as_text, encode=encode_chars).collect()) == sorted(make(as_ids).collect())
    plan = S.stream_windows(as_text, "doc_id", 16, 4, encode=encode_chars)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan[plan.index("Aggregate [block"):].split("\n", 1)[1]  # no array of ids below the group, which is one of blocks
