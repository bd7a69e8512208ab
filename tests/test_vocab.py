"""Vocabulary jobs against step-by-step models on small corpora."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import vocab as V


def words(n=120, seed=3):
    rng = random.Random(seed)
    return {"".join(rng.choice("abcab") for _ in range(rng.randint(1, 9))): rng.randint(1, 40) for _ in range(n)}


def learn(freqs, n):
    state = {w: list(w) for w in freqs}
    merges = []
    while len(merges) < n:
        pairs = Counter()
        for w, s in state.items():
            for pair in zip(s, s[1:]):
                pairs[pair] += freqs[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        state = {w: merge(s, best) for w, s in state.items()}
    return merges


def merge(symbols, pair):
    out, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) == pair:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_learned_merges(spark, seed):
    freqs = words(seed=seed)
    table = spark.createDataFrame(list(freqs.items()), "word string, n long")
    assert V.learn_merges(table, 40, checkpoint_every=3) == learn(freqs, 40)


def test_learning_stops_when_nothing_is_left(spark):
    assert V.learn_merges(spark.createDataFrame([("ab", 2), ("a", 1)], "word string, n long"), 10) == [("a", "b")]


def test_byte_pair_encode(spark):
    freqs = words()
    merges = learn(freqs, 30)
    table = spark.createDataFrame([(w,) for w in freqs], "word string")
    for r in V.byte_pair_dictionary(table, merges, byte_level=False).collect():
        symbols = list(r["word"])
        for pair in merges:
            symbols = merge(symbols, pair)
        assert r["pieces"] == symbols


def by_definition(symbols, merges):
    """All places of the lowest-ranked pair are merged from left to right, until no pair has a rank."""
    ranks = {pair: k for k, pair in reversed(list(enumerate(merges)))}
    while pairs := [p for p in zip(symbols, symbols[1:]) if p in ranks]:
        symbols = merge(symbols, min(pairs, key=ranks.get))
    return symbols


def test_merges_that_feed_each_other():
    rng = random.Random(11)
    for _ in range(300):
        pieces, merges = list("abc"), []
        for _ in range(rng.randrange(12)):
            merges.append((rng.choice(pieces), rng.choice(pieces)))
            pieces.append("".join(merges[-1]))
        if rng.random() < 0.5:
            rng.shuffle(merges)  # ranks that no learning gives
        apply = V.Merger(merges)
        for _ in range(10):
            word = [rng.choice("abc") for _ in range(rng.randrange(30))]
            assert apply(word) == by_definition(word, merges)
    assert V.Merger([("a", "a"), ("aa", "aa")])("a" * 200_001) == ["aaaa"] * 50_000 + ["a"]


def test_byte_letters(spark):
    every = "".join(map(chr, range(0x180))) + "漢😀"
    row = spark.createDataFrame([(every,), ("",)], "word string").select(V.byte_letters(F.col("word")).alias("l"), "word")
    letters = V._byte_letters()
    assert {r["word"]: r["l"] for r in row.collect()} == {w: "".join(letters[b] for b in w.encode()) for w in (every, "")}


def test_byte_level_letters(spark):
    row = V.byte_pair_dictionary(spark.createDataFrame([(" é",)], "word string"), []).first()
    assert row["pieces"] == ["Ġ", "Ã", "©"]


def test_byte_pair_words(spark):
    row = spark.createDataFrame([("I'm  here, 12 times\n",)], "t string").select(V.byte_pair_words(F.col("t")).alias("w")).first()
    assert row["w"] == ["I", "'m", " ", " here", ",", " 12", " times", "\n"]


def test_wordpiece(spark):
    vocab = spark.createDataFrame([("un", 1), ("##aff", 2), ("##able", 3), ("##a", 4), ("u", 5)], "token string, id int")
    table = spark.createDataFrame([("unaffable",), ("una",), ("unx",), ("u" * 101,), ("zz",)], "word string")
    rows = {r["word"]: r["pieces"] for r in V.wordpiece_dictionary(table, vocab, 0).collect()}
    assert rows == {"unaffable": [1, 2, 3], "una": [1, 4], "unx": [0], "u" * 101: [0], "zz": [0]}


def test_basic_tokens(spark):
    row = spark.createDataFrame([("Héllo,[MASK] wörld\u0000​! 中文a ǅ",)], "t string").select(V.basic_tokens(F.col("t")).alias("w")).first()
    assert row["w"][:2] == ["hello", ","]
    assert "[" in row["w"] and "world" in row["w"] and ["中", "文", "a"] == [w for w in row["w"] if w in "中文a"]
    row = spark.createDataFrame([("a [MASK] b",)], "t string").select(V.basic_tokens(F.col("t")).alias("w")).first()
    assert row["w"] == ["a", "[MASK]", "b"]


def test_split_commands(spark):
    split = lambda text: spark.createDataFrame([(text,)], "t string").select(V.split_commands(F.col("t")).alias("p")).first()["p"]
    assert split("a b  [MASK] c[SEP]") == ["a b", "[MASK]", " c", "[SEP]"]
    assert split("[CLS]x") == ["[CLS]", "x"]
    assert split("  ") == []
    assert split("[MASK][MASK]") == ["[MASK]", "[MASK]"]
    df = spark.createDataFrame([("a [MASK1]b <|startofpiece1|> c",)], "t string")
    assert df.select(V.split_commands(F.col("t"), sentinels=2)).first()[0] == ["a", "[MASK1]", "b ", "<|startofpiece1|>", " c"]
    ids = df.select(V.encode_with_commands(F.col("t"), V.encode_chars, 1000, sentinels=2, fixed_ids=True)).first()[0]
    assert ids == [97, 1011, 98, 32, 1012, 32, 99]


def test_command_ids():
    free = {name: i for name, _, i in V.command_rows(100)}
    fixed = {name: i for name, _, i in V.command_rows(100, fixed_ids=True)}
    assert (free["pad"], free["eos"], free["ENC"], free["MASK"], free["sop"], free["eop"], free["gMASK"], free["sMASK"]) == (100, 100, 102, 103, 106, 107, 107, 108)
    assert (fixed["sMASK"], fixed["gMASK"], fixed["dBLOCK"]) == (108, 109, 110)


def test_decode_glues_pieces(spark):
    vocab = spark.createDataFrame([("un", 1), ("##do", 2), ("[SEP]", 3)], "token string, id int")
    df = spark.createDataFrame([(1, [1, 2, 3, 1, 99])], "d int, tokens array<int>")
    assert V.decode_ids(df, ["d"], "tokens", vocab).first()["text"] == "undo [SEP] un"


def test_decode_shared_ids(spark):
    words = spark.createDataFrame([("a", 0)], "token string, id int")
    table = V.assemble_vocab(words, 1)  # eop and gMASK share an id, as pad and eos do
    df = spark.createDataFrame([(1, [0, 8, 1]), (2, [])], "d int, tokens array<int>")
    assert {r["d"]: r["text"] for r in V.decode_ids(df, ["d"], "tokens", table).collect()} == {1: "a [gMASK] <|endoftext|>", 2: ""}


def test_empty_documents_survive_encoding(spark):
    vocab = V.top_words(spark.createDataFrame([("a", 3), ("b", 2)], "word string, n long"), 10)
    df = spark.createDataFrame([(1, ["b", "a", "z"]), (2, [])], "d int, w array<string>")
    rows = {r["d"]: r["tokens"] for r in V.encode_words(df, ["d"], F.col("w"), vocab, unk=9).collect()}
    assert rows == {1: [1, 0, 9], 2: []}


def test_decode_chars_in_all_planes(spark):
    from tokenmill.operators.vocab import decode_chars, encode_chars

    text = "aé€漢😀"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(decode_chars(encode_chars(F.col("t")))).first()[0] == text


def test_places_of_distinct_items(spark):
    rows = [(1, "x", ["b", "a", "b", None, "a", "b"]), (2, "x", []), (3, "y", None), (1, "y", ["a"])]
    frame = spark.createDataFrame(rows, "k int, l string, ws array<string>")
    got = {(r["k"], r["l"], r["word"]): r["places"] for r in V.distinct_places(frame, ["k", "l"], F.col("ws")).collect()}
    assert got == {(1, "x", "b"): [0, 2, 5], (1, "x", "a"): [1, 4], (1, "x", None): [3], (2, "x", None): [], (3, "y", None): [], (1, "y", "a"): [0]}


@pytest.mark.parametrize("most, frequent", [(10**6, 1), (0, 1), (0, 3), (0, 10**4)])
def test_encoding_by_distinct_words(spark, most, frequent):
    rng = random.Random(5)
    rows = [(k, [f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(0, 200))]) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, ws array<string>")
    table = {f"w{k}": [k] * (k % 4) for k in range(50)}
    dictionary = spark.createDataFrame(list(table.items()), "word string, pieces array<int>")
    found = V.answered(V.distinct_places(frame, ["k"], F.col("ws")), "word", dictionary, most, frequent)
    got = V.assembled(found, ["k"], F.coalesce("pieces", F.array(F.lit(-1))), "tokens")
    assert {r["k"]: r["tokens"] for r in got.collect()} == {k: [i for w in ws for i in table.get(w, [-1])] for k, ws in rows}


def test_shuffled_rows_are_distinct_words(spark):
    frame = spark.range(20).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), i % 7)).alias("ws"))
    vocab = spark.createDataFrame([(f"w{k}", k) for k in range(5)], "token string, id int")
    assert V.distinct_places(frame, ["k"], F.col("ws")).count() == 20 * 7
    encoded = V.encode_words(frame, ["k"], F.col("ws"), vocab, unk=9)
    assert all(r["tokens"] == [min(i % 7, 5) if i % 7 < 5 else 9 for i in range(1000)] for r in encoded.collect())
    assert encoded._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("most", [10**6, 0, 1, 7])
def test_items_are_replaced_within_their_rows(spark, most):
    rng = random.Random(6)
    word = lambda: rng.choice([None, "", *(f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(9))])
    rows = [(k % 50 or None, f"l{k % 3}", [word() for _ in range(rng.randrange(0, 30))]) for k in range(200)] + [(7, None, None), (8, "x", [])]
    frame = spark.createDataFrame(rows, "k int, l string, ws array<string>")
    table = [(f"w{k}", [k] * (k % 4)) for k in range(35)] + [("w3", [1, None]), ("w5", None), (None, [99]), ("", [0])]
    dictionary = spark.createDataFrame(table, "word string, pieces array<int>")
    default = F.array(F.lit(-1), F.lit(None).cast("int"))
    found = V.answered(V.distinct_places(frame, ["k", "l"], F.col("ws")), "word", dictionary, 0, 3)
    want = V.assembled(found, ["k", "l"], F.coalesce("pieces", default), "tokens")
    got = V.replaced(frame, ["k", "l"], F.col("ws"), dictionary.toDF("item", "value"), default, "tokens", None, most)
    order = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert order(got) == order(want)


def test_a_row_is_shuffled_once(spark):
    """Not once for each of its distinct words; only words beyond those that are sent go by themselves."""
    frame = spark.range(20).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), i % 50)).alias("ws"))
    dictionary = spark.createDataFrame([(f"w{k}", [k, k]) for k in range(50)], "word string, pieces array<int>")
    out = V.expand_words(frame, ["k"], F.col("ws"), dictionary)
    assert all(r["tokens"] == [i % 50 for i in range(1000) for _ in range(2)] for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan  # answers come with the row
    vocab = spark.createDataFrame([("w", 1), ("##1", 2), ("##12", 3), (None, 4), ("##2", 5)], "token string, id int")
    words = spark.createDataFrame([("w112",), ("",), (None,), ("##1",)], "word string")
    pieces = V.wordpiece_dictionary(words, vocab, 0)
    assert {r["word"]: r["pieces"] for r in pieces.collect()} == {"w112": [1, 2, 3], "": [0], None: [0], "##1": [0]}
    assert "Exchange" not in pieces._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted(spark):
    frame = spark.createDataFrame([(["a", "b", "a", None],), (["a"],), ([],), (None,)], "ws array<string>")
    assert {r["word"]: r["n"] for r in V.distinct_words(frame, F.col("ws")).collect()} == {"a": 3, "b": 1, None: 1}
    text = spark.createDataFrame([("Ab, [MASK] cd\x0b! ΑΣ x",), ("Ab, cd\tE!",), ("ΑΣ É x",), (None,)], "t string")
    got = [r[0] for r in text.select(V.basic_tokens(F.col("t"))).collect()]
    assert got == [["ab", ",", "[MASK]", "cd", "!", "ας", "x"], ["ab", ",", "cd", "e", "!"], ["ας", "e", "x"], None]
