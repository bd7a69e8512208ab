"""Vocabularies as tables, and encoding as joins.

A tokenizer called row by row does the same work again for every copy of a word. Here each distinct word is encoded once and
the result is joined back to the distinct words of each row, which carry the places where they stand. Tables of bounded size are broadcast;
of larger ones only the rows of the most frequent words are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.arrays import let
from tokenmill.functions.text import sentences, split_words, strip_accents
from tokenmill.session import cut_lineage

BROADCAST_WORDS = 1 << 18  # rows of a table that is broadcast as a whole
FREQUENT_WORDS = 1 << 14  # rows of a larger table that are
PLACE_ROWS = 1024  # rows of an Arrow batch whose items are numbered at once

# Surface forms of the command tokens.
COMMAND_TOKENS = {
    "pad": "<|endoftext|>",
    "eos": "<|endoftext|>",
    "sep": "[SEP]",
    "ENC": "[CLS]",
    "MASK": "[MASK]",
    "unk": "[UNK]",
    "sop": "<|startofpiece|>",
    "eop": "<|endofpiece|>",
    "gMASK": "[gMASK]",
    "sMASK": "[sMASK]",
    "dBLOCK": "[dBLOCK]",
}
# Command tokens that absorb the white space to their left.
LEFT_STRIPPING = ("MASK", "gMASK", "sMASK")
MASK = COMMAND_TOKENS["MASK"]
# Words that basic tokenization keeps whole.
PROTECTED_WORDS = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
# Characters that end a sentence, per use.
SENTENCE_END_BLOCK = ".?!;:\n"
SENTENCE_END_MASKING = ".?!;:。？！；…\n"
SENTENCE_END_CAUSAL = ".?!"

# Characters that basic tokenization drops, splits off as CJK, or takes as punctuation.
CONTROL = r"[\x00�]|[\p{C}&&[^\t\n\r]]"
CJK = (
    r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}"
    r"\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])"
)
PUNCTUATION = r"[!-/:-@\[-`{-~\p{P}]"


# --- words -----------------------------------------------------------------------------------------------------------


def word_positions(df: DataFrame, keys: Sequence[str], words: Column, out: str = "word") -> DataFrame:
    """One row per word with its position."""
    return df.select(*keys, F.posexplode(words).alias("pos", out))


def word_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """Count of every white-space word; counts are combined before the shuffle, so frequent words are no hot spot."""
    return df.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequency_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of sentences, and length of the longest line that holds one."""
    lines = df.select(F.explode(F.split(F.trim(F.col(text)), "\n")).alias("line")).filter("line <> ''")
    return lines.agg(
        F.sum(F.size(sentences(F.col("line")))).alias("n_sentences"),
        F.max(F.length("line")).cast("bigint").alias("longest_line"),
    )


def top_words(frequencies: DataFrame, size: int) -> DataFrame:
    """The `size` most frequent words with dense ids from 0; ties by word."""
    top = frequencies.orderBy(F.col("n").desc(), "word").limit(size)  # the vocabulary size is the feature
    # The window sees `size` rows, which the limit has brought to one place already.
    number = F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) - 1
    return top.select(F.col("word").alias("token"), number.alias("id"), "n")


def basic_tokens(text: Column) -> Column:
    """Lower-case, accent-free words with every punctuation mark and CJK character on its own.

    Only a text that holds a protected word is taken apart into its words first (white space ends the context of lower-casing),
    and only one beyond printable ASCII is searched for what basic tokenization drops.
    """
    marks = rf"\[(?:{'|'.join(w[1:-1] for w in PROTECTED_WORDS)})\]"

    def words(whole: Column, plain: Callable[[Column], Column]) -> Column:
        single = F.transform(
            split_words(whole),
            lambda w: F.when(w.isin(*PROTECTED_WORDS), F.array(w)).otherwise(
                F.regexp_extract_all(plain(w), F.lit(f"{PUNCTUATION}|[^!-/:-@\\[-`{{-~\\p{{P}}]+"), F.lit(0))),
        )
        at_once = F.regexp_extract_all(plain(whole), F.lit(f"(?U){PUNCTUATION}|[^!-/:-@\\[-`{{-~\\p{{P}}\\s]+"), F.lit(0))
        return F.when(whole.rlike(marks), F.flatten(single)).otherwise(at_once)

    cleaned = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), CJK, r" $1 ")
    beyond = let(cleaned, lambda whole: words(whole, lambda part: strip_accents(F.lower(part))))
    return F.when(text.rlike(r"[^\t\n\r\x20-\x7E]"), beyond).otherwise(words(text, F.lower))


def sentence_end(token: Column, marks: str = SENTENCE_END_MASKING) -> Column:
    """Whether a token contains a sentence end."""
    return token.rlike("[" + marks.replace("\n", "\\n") + "]")


# --- vocabularies ----------------------------------------------------------------------------------------------------


def command_rows(
    first_id: int, blocks: bool = True, task_mask: bool = True, decoder_mask: bool = True, sentinels: int = 0, fixed_ids: bool = False
) -> list[tuple[str, str, int]]:
    """(name, surface, id) of the command tokens behind a text vocabulary of `first_id` tokens.

    pad and eos share an id. The block tokens leave one id unused in front of them; with `fixed_ids` the following tokens
    count that gap, without it they start one id earlier and the task masks come in the other order.
    """
    rows = [("pad", first_id), ("eos", first_id), ("sep", first_id + 1), ("ENC", first_id + 2), ("MASK", first_id + 3), ("unk", first_id + 4)]
    following = first_id + 5
    if blocks:
        rows += [("sop", following + 1), ("eop", following + 2)]
        following += 3 if fixed_ids else 2
        if task_mask:
            names = ("sMASK", "gMASK") if fixed_ids else ("gMASK", "sMASK")
            rows += [(names[0], following), (names[1], following + 1)]
            following += 2
        if decoder_mask:
            rows.append(("dBLOCK", following))
            following += 1
    named = [(name, COMMAND_TOKENS[name], number) for name, number in rows]
    for i in range(1, sentinels):
        named += [(f"MASK{i}", f"[MASK{i}]", following), (f"sop{i}", f"<|startofpiece{i}|>", following + 1)]
        following += 2
    return named


def assemble_vocab(text_vocab: DataFrame, text_size: int, commands_first: bool = False, **options) -> DataFrame:
    """Text tokens (token, id from 0) and command tokens in one table; commands go behind the text ids or in front of them."""
    rows = command_rows(0 if commands_first else text_size, **options)
    shift = 1 + max(number for _, _, number in rows) if commands_first else 0
    spark: SparkSession = text_vocab.sparkSession
    commands = spark.createDataFrame(rows, "name string, token string, id int").withColumn("is_command", F.lit(True))
    words = text_vocab.select(F.lit(None).cast("string").alias("name"), "token", (F.col("id") + shift).cast("int").alias("id"), F.lit(False).alias("is_command"))
    return words.unionByName(commands)


def padded_size(n_tokens: Column, multiple: int) -> Column:
    """Vocabulary size rounded up for the embedding table."""
    return F.ceil(n_tokens / multiple) * multiple


# --- encoding and decoding -------------------------------------------------------------------------------------------


def distinct_places(df: DataFrame, keys: Sequence[str], items: Column, name: str = "word") -> DataFrame:
    """(keys, name, places): a row for each distinct item of a row's array with the places where it stands; rows without items keep one without item.

    Arrow batches are numbered and sorted as a whole, so Python sees no single item.
    """
    kind = df.select(items.alias("i")).schema["i"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PLACE_ROWS):
                batch = whole.slice(first, PLACE_ROWS)
                column = batch.column("__items")
                sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
                coded = pc.dictionary_encode(column.flatten(), null_encoding="encode")
                codes, n = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                group = row * n + codes
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                at = group[order][starts]
                none = np.flatnonzero(sizes == 0)
                rows = np.concatenate([at // n, none])
                found = pa.concat_arrays([coded.dictionary.take(pa.array(at % n)), pa.nulls(len(none), coded.dictionary.type)])
                offsets = np.concatenate([starts, np.full(len(none) + 1, len(codes))]).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in keys), found, places], [*keys, name, "places"])

    head = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, items.alias("__items")).mapInArrow(run, f"{head}, `{name}` {kind}, places array<int>")


def answered(places: DataFrame, name: str, table: DataFrame, most: int = BROADCAST_WORDS, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """`places` with the columns of `table(name, ...)`, null where it has no row.

    A table of up to `most` rows is broadcast. Of a larger one the rows of the `frequent` items that most rows hold are broadcast;
    any other item is in a share of 1/frequent of all rows at most, so none is a hot key of the shuffle join.
    """
    table = cut_lineage(table)
    if table.count() <= most:
        return places.join(F.broadcast(table), name, "left")
    places = cut_lineage(places)
    top = places.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), name).limit(frequent).select(name)
    known = cut_lineage(top.join(table, name, "left").withColumn("__known", F.lit(True)))
    marked = places.join(F.broadcast(known), name, "left")
    here = F.col("__known").isNotNull() | F.col(name).isNull()
    rest = marked.filter(~here).select(*places.columns).join(table, name, "left")
    return marked.filter(here).drop("__known").unionByName(rest)


def assembled(rows: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """(keys, out): the arrays `value` of a row's items, put in order by their `places` and joined."""
    grouped = rows.select(*keys, F.struct("places", value.alias("value")).alias("__i")).groupBy(*keys).agg(F.collect_list("__i").alias("__is"))
    spread = F.flatten(F.transform("__is", lambda i: F.transform(i["places"], lambda p: F.struct(p.alias("p"), i["value"].alias("v")))))
    return grouped.select(*keys, F.flatten(F.transform(F.array_sort(spread), lambda x: x["v"])).alias(out))


def replaced(df: DataFrame, keys: Sequence[str], items: Column, table: DataFrame, default: Column, out: str, counts: DataFrame | None = None, most: int = BROADCAST_WORDS) -> DataFrame:
    """(keys, out): the arrays that `table(item, value)` gives for a row's items, in their order; `default` for an item that it lacks. Rows with equal keys become one.

    Up to `most` items are sent to the tasks: all of the table, or those that stand most often by `counts(item, n)`; no other item is in more than
    a share of 1/most of all places, so none is a hot key of the join that answers the rest. A row is shuffled once, as its sent answers, beside its other items.
    """
    table = cut_lineage(table.filter("item IS NOT NULL").withColumn("value", F.coalesce("value", default)))
    kind = table.schema["value"].dataType.elementType.simpleString()
    some, n = table, table.count()
    if n > most:
        counts = item_counts(df, items) if counts is None else counts
        top = counts.filter("item IS NOT NULL").orderBy(F.desc("n"), "item").limit(most).select("item")
        some = top.join(table, "item", "left").withColumn("value", F.coalesce("value", default))
    single = some.groupBy("item").agg(F.count("*").alias("rows"), F.first("value").alias("value")).filter("rows = 1").select("item", "value").toArrow()
    closed = n <= most and single.num_rows == n  # an item with several rows in the table is joined with them
    sent = df.sparkSession.sparkContext.broadcast(single)
    other = df.sparkSession.range(1).select(default.cast(f"array<{kind}>").alias("value")).first()["value"]
    head = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    rows = df.select(*keys, items.alias("__items"))

    def coded(column: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Sizes of the rows, and for each item its place in `words` (behind them: nowhere) and the distinct items in which it can be found."""
        own = pc.dictionary_encode(column.flatten(), null_encoding="encode")
        known = np.asarray(pc.fill_null(pc.index_in(own.dictionary, value_set=words), len(words))).astype(np.int64)
        if not closed:  # no row of the table answers null
            known[np.asarray(pc.is_null(own.dictionary))] = len(words) + 1
        return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64), known, own

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each row: how many values each of its items has, and the values; items that are not known here have none."""
        answers = sent.value.column("value").combine_chunks()
        words, kind_of = sent.value.column("item").combine_chunks(), answers.type.value_type
        lengths = np.concatenate([np.asarray(pc.list_value_length(answers)).astype(np.int64), [len(other) if closed else 0, len(other)]])
        starts = np.cumsum(lengths) - lengths
        starts[-1] -= len(other) if closed else 0
        flat = pa.concat_arrays([answers.flatten(), pa.array(other, kind_of)])
        for whole in batches:
            for first in range(0, whole.num_rows, PLACE_ROWS):
                batch = whole.slice(first, PLACE_ROWS)
                counted, known, own = coded(batch.column("__items"), words)
                at = known[np.asarray(own.indices)]
                sizes = lengths[at]
                ends = np.cumsum(sizes)
                values = flat.take(pa.array(np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + sizes, sizes)))
                rims = np.concatenate([[0], np.cumsum(counted)])
                lists = pa.ListArray.from_arrays(pa.array(rims.astype(np.int32)), pa.array(sizes.astype(np.int32)))
                cuts = np.concatenate([[0], ends])[rims].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), lists, pa.ListArray.from_arrays(pa.array(cuts), values)], [*keys, "sizes", "values"])

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each place of an item that is not known here."""
        words = sent.value.column("item").combine_chunks()
        for whole in batches:
            for first in range(0, whole.num_rows, PLACE_ROWS):
                batch = whole.slice(first, PLACE_ROWS)
                counted, known, own = coded(batch.column("__items"), words)
                codes = np.asarray(own.indices).astype(np.int64)
                open_ = np.flatnonzero(known[codes] == len(words))
                rims = np.cumsum(counted)
                row = np.searchsorted(rims, open_, "right")
                place = open_ - (rims - counted)[row]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), own.dictionary.take(pa.array(codes[open_])), pa.array(place.astype(np.int32))], [*keys, "item", "place"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Values of each group by place; values of one place, which only rows with equal keys have, by themselves."""
        for whole in batches:
            for first in range(0, whole.num_rows, PLACE_ROWS):
                batch = whole.slice(first, PLACE_ROWS)
                group = batch.column("__parts")
                per_group = np.asarray(pc.list_value_length(group)).astype(np.int64)
                parts = group.flatten()
                part_place, sizes_of, values = (pc.struct_field(parts, name) for name in ("place", "sizes", "values"))
                alone = np.asarray(pc.is_null(sizes_of))
                n_values = np.asarray(pc.list_value_length(values)).astype(np.int64)
                items_of = np.where(alone, 1, np.asarray(pc.fill_null(pc.list_value_length(sizes_of), 0))).astype(np.int64)
                part = np.repeat(np.arange(len(parts)), items_of)
                begins = np.cumsum(items_of) - items_of
                place = np.arange(len(part)) - begins[part]
                size = np.zeros(len(part), np.int64)
                size[~alone[part]] = np.asarray(sizes_of.flatten())
                place[begins[alone]], size[begins[alone]] = np.asarray(pc.fill_null(part_place, 0))[alone], n_values[alone]
                start = np.cumsum(size) - size
                row = np.repeat(np.arange(len(group)), per_group)[part]
                kept = np.flatnonzero(size)
                kept = kept[np.lexsort((place[kept], row[kept]))]
                flat = values.flatten()
                again = np.flatnonzero((np.diff(row[kept]) == 0) & (np.diff(place[kept]) == 0))
                for run in np.split(again, np.flatnonzero(np.diff(again) > 1) + 1) if len(again) else []:
                    tied = kept[run[0]:run[-1] + 2]
                    kept[run[0]:run[-1] + 2] = sorted(tied, key=lambda i: [(v is not None, v) for v in flat.slice(start[i], size[i]).to_pylist()])
                ends = np.cumsum(size[kept])
                taken = flat.take(pa.array(np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[kept] - ends + size[kept], size[kept])))
                cuts = np.concatenate([[0], ends])[np.searchsorted(row[kept], np.arange(len(group) + 1))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.ListArray.from_arrays(pa.array(cuts), taken)], [*keys, out])

    answers = rows.mapInArrow(here, f"{head}sizes array<int>, values array<{kind}>").select(*keys, F.lit(None).cast("int").alias("place"), "sizes", "values")
    if not closed:
        rest = rows.mapInArrow(elsewhere, f"{head}item {table.schema['item'].dataType.simpleString()}, place int").join(table, "item", "left")
        answers = answers.unionByName(rest.select(*keys, "place", F.lit(None).cast("array<int>").alias("sizes"), F.coalesce("value", default).alias("values")))
    grouped = answers.groupBy(*keys).agg(F.collect_list(F.struct("place", "sizes", "values")).alias("__parts"))
    return grouped.mapInArrow(ordered, f"{head}`{out}` array<{kind}>")


def encode_words(df: DataFrame, keys: Sequence[str], words: Column, vocab: DataFrame, unk: int, out: str = "tokens") -> DataFrame:
    """Whole-word ids in text order; `vocab` is (token, id). Rows without words come back with an empty array."""
    table = vocab.select(F.col("token").alias("item"), F.array(F.coalesce(F.col("id").cast("int"), F.lit(unk))).alias("value"))
    return replaced(df, keys, words, table, F.array(F.lit(unk)), out)


def expand_words(df: DataFrame, keys: Sequence[str], words: Column, dictionary: DataFrame, out: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    """Replace every word by its pieces from `dictionary(word, pieces)`; words that it lacks give none. `counts` are those of `distinct_words`, if at hand."""
    none = F.array().cast(dictionary.schema["pieces"].dataType)
    table = dictionary.select(F.col("word").alias("item"), F.col("pieces").alias("value"))
    return replaced(df, keys, words, table, none, out, counts if counts is None else counts.withColumnRenamed("word", "item"))


def item_counts(df: DataFrame, items: Column) -> DataFrame:
    """(item, n): each distinct item of the arrays and how often it stands; Arrow counts some rows at once, before Spark does."""
    kind = df.select(items.alias("i")).schema["i"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, PLACE_ROWS):
                counted = pc.value_counts(batch.column("i").slice(first, PLACE_ROWS).flatten())
                yield pa.RecordBatch.from_struct_array(counted).rename_columns(["item", "n"])

    return df.select(items.alias("i")).mapInArrow(run, f"item {kind}, n long").groupBy("item").agg(F.sum("n").alias("n"))


def distinct_words(df: DataFrame, words: Column) -> DataFrame:
    """(word, n): each distinct word and how often it stands."""
    return item_counts(df, words).withColumnRenamed("item", "word")


def wordpiece_dictionary(words: DataFrame, vocab: DataFrame, unk: int, max_chars: int = 100) -> DataFrame:
    """Greedy longest-match pieces of each distinct word; over-long or unmatched words become `unk`.

    `vocab` is bounded by its size and shipped to the tasks once; Python sees distinct words in Arrow batches.
    """
    rows = vocab.filter("token IS NOT NULL").groupBy("token").agg(F.max(F.col("id").cast("int")).alias("id")).collect()
    sent = words.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in rows})

    def walk(word: str | None, ids: dict[str, int | None], longest: int) -> list[int | None]:
        out: list[int | None] = []
        at, end = 0, len(word or "")
        if not end or end > max_chars:
            return [unk]
        while at < end:
            for stop in range(min(end, at + longest), at, -1):
                piece = "##" + word[at:stop] if at else word[:stop]
                if piece in ids:
                    out.append(ids[piece])
                    at = stop
                    break
            else:
                return [unk]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value
        longest = max((len(t.removeprefix("##")) for t in ids), default=0)
        for batch in batches:
            pieces = [walk(word, ids, longest) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(pieces, pa.list_(pa.int32()))], ["word", "pieces"])

    return words.select("word").mapInArrow(run, "word string, pieces array<int>")


def _byte_letters() -> list[str]:
    """A printable letter per byte: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    letters = {b: chr(b) for b in printable}
    hidden = [b for b in range(256) if b not in letters]
    letters.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return [letters[b] for b in range(256)]


# Fixed value: pattern that cuts text into byte-pair words, keeping the space in front of a word.
BYTE_PAIR_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_pair_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BYTE_PAIR_WORDS), F.lit(0))


def byte_letters(text: Column) -> Column:
    """The text in letters of its UTF-8 bytes, one for each, so that merges can be learned on it."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    table = F.array(*map(F.lit, _byte_letters()))
    return let(table, lambda letters: F.array_join(F.transform(pairs, lambda h: F.get(letters, F.conv(h, 16, 10).cast("int"))), ""))


class Merger:
    """Byte-pair merges of one word: symbols in a linked list, possible merges in a heap by rank and place.

    All merges of the lowest rank are applied from left to right before the next rank is looked for; what they make possible goes
    into the heap. A word of n letters takes in the order of n log n steps, however often merges feed each other.
    """

    def __init__(self, merges: Sequence[tuple[str, str]]):
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(merges):
            self.ranks.setdefault(tuple(pair), rank)

    def __call__(self, letters: Sequence[str]) -> list[str]:
        symbols: list[str | None] = list(letters)
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        heapify(heap)
        while heap:
            rank, made = heap[0][0], []
            while heap and heap[0][0] == rank:
                _, i = heappop(heap)
                j = after[i]
                if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                    continue  # one of the two is part of another merge by now
                symbols[i], symbols[j], after[i] = symbols[i] + symbols[j], None, after[j]
                if after[j] < n:
                    before[after[j]] = i
                made.append(i)
            for i in made:
                for left in (before[i], i):
                    if left >= 0 and symbols[left] is not None and after[left] < n and (own := ranks.get((symbols[left], symbols[after[left]]))) is not None:
                        heappush(heap, (own, left))
        return [s for s in symbols if s is not None]


def byte_pair_dictionary(words: DataFrame, merges: Sequence[tuple[str, str]], byte_level: bool = True) -> DataFrame:
    """(word, pieces) of each distinct word after all merges, lowest rank first.

    `merges` is bounded by the vocabulary size and shipped to the tasks once; Python sees distinct words in Arrow batches.
    """
    sent = words.sparkSession.sparkContext.broadcast(list(merges))
    letters = _byte_letters()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = Merger(sent.value)
        for batch in batches:
            pieces = [merge([letters[b] for b in word.encode()] if byte_level else word) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(pieces, pa.list_(pa.string()))], ["word", "pieces"])

    return words.select("word").mapInArrow(encode, "word string, pieces array<string>")


def decode_ids(df: DataFrame, keys: Sequence[str], tokens: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """Ids back to text: surface forms joined by spaces, `##` pieces glued to the piece before; unknown ids vanish, rows without ids are empty.

    Where two tokens share an id, a command goes before text and the later name of the command list before the earlier.
    """
    last = F.lit(0)
    if "name" in vocab.columns:
        last = F.coalesce(F.array_position(F.array(*map(F.lit, COMMAND_TOKENS)), F.col("name")), F.lit(0))
    surface = vocab.groupBy("id").agg(F.max_by("token", F.struct(last, "token")).alias("token"))
    none = F.array().cast("array<string>")
    table = surface.select(F.col("id").alias("item"), F.when(F.col("token").isNull(), none).otherwise(F.array("token")).alias("value"))
    joined = replaced(df, keys, F.col(tokens), table, none, "__tokens")
    return joined.select(*keys, F.regexp_replace(F.array_join("__tokens", " "), " ##", "").alias(out))


def encode_chars(text: Column) -> Column:
    """Character-level ids: the code points."""
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def decode_chars(tokens: Column) -> Column:
    """Text of character-level ids, in all planes."""
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(t), 8, "0")), "UTF-32")), "")


def split_commands(
    text: Column, left_strip: Sequence[str] = tuple(COMMAND_TOKENS[n] for n in LEFT_STRIPPING), right_strip: Sequence[str] = (), sentinels: int = 0
) -> Column:
    """Cut text around command tokens, numbered sentinels among them; some of them absorb the white space at one side."""
    def alternation(tokens):
        return "|".join(re.escape(token) for token in sorted(set(tokens)))

    if MASK in left_strip:
        left_strip = (*left_strip, *(surface for name, surface, _ in command_rows(0, sentinels=sentinels) if name.startswith("MASK")))

    if left_strip:
        text = F.regexp_replace(text, rf"\s+(?={alternation(left_strip)})", "")
    if right_strip:
        text = F.regexp_replace(text, rf"(?<={alternation(right_strip)})\s+", "")
    commands = alternation(surface for _, surface, _ in command_rows(0, sentinels=sentinels))
    cut = F.filter(F.split(text, f"(?={commands})|(?<={commands})"), lambda piece: piece != "")
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(cut)


def encode_with_commands(text: Column, encode: Callable[[Column], Column], first_id: int, sentinels: int = 0, **options) -> Column:
    """Ids of a text: commands by their table, the pieces between them by `encode`."""
    ids = {surface: number for _, surface, number in command_rows(first_id, sentinels=sentinels, **options)}  # of two names for a surface the later counts
    table = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    pieces = split_commands(text, sentinels=sentinels)
    return F.flatten(F.transform(pieces, lambda p: F.when(p.isin(*ids), F.array(F.try_element_at(table, p))).otherwise(encode(p))))


def token_stats(df: DataFrame, tokens: str, original: Column) -> DataFrame:
    """Document count, tokens, and tokens before tokenization."""
    return df.agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size(tokens)).cast("bigint").alias("n_tokens"),
        F.sum(original).cast("bigint").alias("n_original"),
    )


# --- learning --------------------------------------------------------------------------------------------------------

CANDIDATE_PAIRS = 1000  # pairs looked at per round; a round stops earlier when it must, so this bounds work, not results


def _independent_prefix(pairs: list[tuple[str, str, int]], made: set[str], wanted: int) -> list[tuple[str, str]]:
    """The leading pairs that can be merged in one round with the same outcome as one by one.

    Merging (a, b) can lower only pairs that contain a or b, and a pair it creates occurs no more often than some pair that
    contains a or b. So every pair strictly more frequent than the first such pair keeps its place. A symbol that some other
    merge makes as well could become more frequent than that; such a pair is merged in a round of its own.
    """
    used: set[str] = set()
    floor = pairs[-1][2] if len(pairs) == CANDIDATE_PAIRS else 0
    for left, right, count in pairs:
        if left in used or right in used:
            floor = max(floor, count)
            break
        used.update((left, right))
    chosen: list[tuple[str, str]] = []
    used, made = set(), set(made)
    for left, right, count in pairs:
        if chosen and (count <= floor or left in used or right in used or left + right in made):
            break
        chosen.append((left, right))
        used.update((left, right))
        if left + right in made:
            break
        made.add(left + right)
    return chosen[:wanted]


def learn_merges(frequencies: DataFrame, n_merges: int, checkpoint_every: int = 8) -> list[tuple[str, str]]:
    """Byte-pair merges of a (word, n) table: repeatedly merge the most frequent adjacent pair, ties by pair.

    Each round counts weighted pairs over all distinct words, brings the few most frequent pairs to the driver, and rewrites
    the words. Words are strings in which every symbol has a space on both sides, so a merge is one string replacement.
    """
    spaced = F.regexp_replace("word", r"(?s)(.)", " $1 ")
    state = cut_lineage(frequencies.filter("word <> ''").select(spaced.alias("symbols"), "n"))
    merges: list[tuple[str, str]] = []
    rounds = 0
    while len(merges) < n_merges:
        symbols = F.split(F.trim("symbols"), "  ")
        adjacent = F.arrays_zip(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("l"), F.slice("s", 2, F.size("s")).alias("r"))
        counted = state.select("n", symbols.alias("s")).filter(F.size("s") > 1).select("n", F.explode(adjacent).alias("p"))
        counted = counted.groupBy("p.l", "p.r").agg(F.sum("n").alias("n"))
        top = counted.orderBy(F.col("n").desc(), "l", "r").limit(CANDIDATE_PAIRS).collect()
        if not top:
            break
        made = {left + right for left, right in merges}
        chosen = _independent_prefix([(row["l"], row["r"], row["n"]) for row in top], made, n_merges - len(merges))
        rewritten = F.col("symbols")
        for left, right in chosen:
            rewritten = F.replace(rewritten, F.lit(f" {left}  {right} "), F.lit(f" {left}{right} "))
        state = state.select(rewritten.alias("symbols"), "n")
        merges += chosen
        rounds += 1
        if rounds % checkpoint_every == 0:
            state = cut_lineage(state)
    return merges
