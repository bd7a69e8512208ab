"""Documents of token ids to training and evaluation sequences.

Work on one document stays in array expressions, so nothing is exploded token by token. Long documents are cut into their
pieces before the explode; no row ever carries a whole document next to each of its pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions import arrays as A
from tokenmill.functions.hashing import hash_below, hash_uniform, heads
from tokenmill.operators.prefix import position, running_total
from tokenmill.operators.rangejoin import range_join
from tokenmill.operators.sampling import weight_line, weighted_draws
from tokenmill.session import cut_lineage

PAIR_TRIES = 4  # sentence-pair attempts per round; the first good one counts
PAIR_SENTENCES = 64  # of a document that a pair joins with
PIECE_TOKENS = 1024  # of a document that a draw joins with; a draw reads the pieces that it needs
BLOCK_WINDOWS = 64  # windows over the stream that are cut from one row
FIRST_DRAWS = 4  # draws per sample in the first round; unfilled samples get four times as many in each further round


def digits(value: int, count: Column) -> Column:
    return F.repeat(F.lit(str(value)), count)


def from_prompt(prompt: Column, text: Column, size: Callable[[Column], Column] = F.size, repeat: Callable[[int, Column], Column] = A.repeat) -> Column:
    """Training item of a document: prompt tokens carry no loss, text tokens do.

    `size` and `repeat` are for texts whose characters are the tokens (F.length and `digits`).
    """
    return F.struct(F.concat(prompt, text).alias("tokens"), F.concat(repeat(0, size(prompt)), repeat(1, size(text))).alias("loss_mask"))


def loss_from_runs(runs: Column) -> Column:
    """Loss mask of alternating run lengths: even runs 0, odd runs 1."""
    return F.flatten(F.transform(runs, lambda n, i: A.repeat((i % 2).cast("int"), n)))


def in_ids(token: Column, ids: Sequence[int]) -> Column:
    return token.isin(list(ids))


# --- contiguous chunks -----------------------------------------------------------------------------------------------


class Form:
    """Tokens as arrays of ids, or with `encode` as texts whose characters are the tokens, and losses as texts of digits.

    Texts take a fraction of the bytes of arrays when they are shuffled, and are encoded once they have met.
    """

    def __init__(self, encode: Callable[[Column], Column] | None):
        self.encode, self.kind = encode, "array<int>" if encode is None else "string"

    def size(self, tokens: Column) -> Column:
        return F.size(tokens) if self.encode is None else F.length(tokens)

    def take(self, tokens: Column, start: Column | int, count: Column | int) -> Column:
        if self.encode is None:
            return A.take(tokens, start, count)
        start, count = (x if isinstance(x, Column) else F.lit(x) for x in (start, count))
        return tokens.substr((start + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int"))

    def pieces(self, tokens: Column, length: int) -> Column:
        """The tokens cut every `length` of them, in one pass; null without tokens."""
        if self.encode is not None:
            cut = F.regexp_extract_all(tokens, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))
        else:
            numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.size(tokens) - 1) / length))
            cut = F.transform(numbers, lambda k: A.take(tokens, k * length, length))
        return F.when(self.size(tokens) > 0, cut)

    def one(self, token: int) -> Column:
        return F.array(F.lit(token)) if self.encode is None else F.lit(chr(token))

    def flag(self, value: int) -> Column:
        return F.array(F.lit(value)) if self.encode is None else F.lit(str(value))

    def none(self) -> Column:
        return F.array().cast("array<int>") if self.encode is None else F.lit("")

    def joined(self, parts: Column) -> Column:
        return F.flatten(parts) if self.encode is None else F.array_join(parts, "")

    def ids(self, tokens: Column) -> Column:
        return tokens if self.encode is None else self.encode(tokens)

    def flags(self, loss: Column) -> Column:
        if self.encode is None:
            return loss
        return F.when(loss == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(loss, ""), lambda c: F.ascii(c) - 48))


def _stream_places(docs: DataFrame, order: str, length: int, form: Form) -> tuple[DataFrame, DataFrame]:
    """Sizes of the documents that hold tokens, and (order, __k, __lo, __n) for each of their pieces of `length` tokens; __lo is the document's place."""
    # Filtered behind the checkpoint: a filter before it would make all tokens a second time.
    sizes = cut_lineage(docs.select(order, form.size(F.col("tokens")).cast("bigint").alias("__n"))).filter("__n > 0")
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / length))
    return sizes, running_total(sizes, order, F.col("__n"), "__lo").withColumn("__k", F.explode(pieces))


def contiguous_chunks(
    docs: DataFrame, order: str, length: int, eos: int, pad: int, mem_len: int | None = None, encode: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Cut the concatenation of all documents into chunks of `length` tokens.

    `docs` has (order, tokens, loss_mask). Chunk c covers global tokens [c*length, (c+1)*length); targets are the next tokens
    with `eos` at a document's end; `history` counts earlier tokens of the document the chunk starts in.

    Sizes alone are sorted to find where documents begin. Documents are cut into pieces of `length` tokens where they lie; only pieces meet
    their place, one key for each, and a piece goes to the one or two chunks that it reaches into. Targets are the tokens of a piece and one more,
    so they are made in the chunk. With `encode` the tokens are texts (see Form).
    """
    mem_len = length if mem_len is None else mem_len
    form = Form(encode)
    sizes, places = _stream_places(docs, order, length, form)

    def with_next(tokens: Column, loss: Column) -> Column:
        """Each piece with the token, and the loss, that follow it."""
        after = lambda ps, k, last: F.coalesce(form.take(F.get(ps, k + 1), 0, 1), last)
        return A.let(F.struct(tokens.alias("t"), loss.alias("l")), lambda v: F.transform(v["t"], lambda p, k: F.struct(
            k.cast("bigint").alias("__k"), p.alias("tokens"), after(v["t"], k, form.one(eos)).alias("next"),
            F.get(v["l"], k).alias("loss"), after(v["l"], k, form.flag(1)).alias("next_loss"))))

    pieces = with_next(form.pieces(F.col("tokens"), length), form.pieces(F.col("loss_mask").cast(form.kind), length))
    cut = docs.select(order, F.explode(F.when(form.size(F.col("tokens")) > 0, pieces)).alias("p")).select(order, "p.*")
    placed = cut.join(places, [order, "__k"]).withColumn("lo", F.col("__lo") + F.col("__k") * length)
    first = F.floor(F.col("lo") / length)
    room = (first + 1) * length - F.col("lo")
    size = form.size(F.col("tokens")).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def part(chunk: Column, begin: Column, count: Column, torn: bool) -> Column:
        arrays = [form.take(F.col(name), begin, count).alias(name) for name in ("tokens", "loss")]
        after = [(form.take(F.col(of), begin + count, 1) if torn else F.col(name)).alias(name) for name, of in (("next", "tokens"), ("next_loss", "loss"))]
        return F.struct(chunk.alias("chunk"), (F.col("lo") + begin).alias("lo"), *arrays, *after, F.least(F.lit(mem_len).cast("bigint"), F.col("__k") * length + begin).alias("history"))

    whole, head, rest = part(first, zero, size, False), part(first, zero, room, True), part(first + 1, room, size - room, False)
    parts = placed.select(F.explode(F.when(size > room, F.array(head, rest)).otherwise(F.array(whole))).alias("p")).select("p.*")
    # The last chunk exists even when no token falls into it.
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("lo"))
    empty = [form.none().alias(name) for name in ("tokens", "loss", "next", "next_loss")]
    last = total.select(F.floor(F.col("lo") / length).alias("chunk"), "lo", *empty, F.lit(0).cast("bigint").alias("history"))
    # A chunk holds at most `length` tokens, so its group is bounded.
    ordered = F.sort_array(F.collect_list(F.struct("lo", "tokens", "loss", "next", "next_loss", "history")))
    grouped = parts.unionByName(last).groupBy("chunk").agg(ordered.alias("ps"))
    # A part and its next token are encoded once, for the tokens and the targets.
    encoded = F.transform("ps", lambda p: F.struct(
        form.ids(F.concat(p["tokens"], p["next"])).alias("t"), form.flags(F.concat(form.take(p["loss"], 1, length), p["next_loss"])).alias("l")))
    chunks = grouped.select("chunk", encoded.alias("es"), F.element_at("ps", 1)["history"].alias("history"))

    def column(part: Callable[[Column], Column], filler: int, name: str) -> Column:
        return A.pad(F.flatten(F.transform("es", part)), length, filler).alias(name)

    return chunks.select(
        "chunk", column(lambda e: A.head(e["t"], F.size(e["t"]) - 1), pad, "tokens"), column(lambda e: A.drop(e["t"], 1), pad, "target"),
        column(lambda e: e["l"], 0, "loss"), "history")


# --- weighted packing ------------------------------------------------------------------------------------------------


def _enough_draws(
    samples: DataFrame, sample: str, docs: DataFrame, order: str, budget: int, cost: Callable[[Column], Column], seed: str | int, width: int
) -> DataFrame:
    """Numbered weighted draws per sample until their summed cost reaches `budget`.

    The number of draws is not known in advance. Draw k of a sample is a hash of (sample, k), so drawing more for the samples
    that are not full yet continues the same sequence; the rounds end because every draw costs at least one token.
    """
    line = cut_lineage(weight_line(docs, order, F.size("tokens")))
    open_samples = samples.select(sample, F.lit(0).cast("bigint").alias("__have"))
    first, count, parts = 0, FIRST_DRAWS, []
    while True:
        draws = open_samples.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))))
        drawn = weighted_draws(draws, [sample, "draw"], line, seed, width)
        before = Window.partitionBy(sample).orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
        drawn = drawn.withColumn("size", F.col("hi") - F.col("lo"))
        drawn = drawn.withColumn("__cost", cost(F.col("size")).cast("bigint"))
        drawn = drawn.withColumn("before", F.col("__have") + F.coalesce(F.sum("__cost").over(before), F.lit(0)))
        drawn = cut_lineage(drawn.select(sample, "draw", order, "size", "before", (F.col("before") + F.col("__cost")).alias("after")))
        parts.append(drawn.filter(F.col("before") < budget))
        open_samples = drawn.groupBy(sample).agg(F.max("after").alias("__have")).filter(F.col("__have") < budget)
        if open_samples.isEmpty():
            break
        first, count = first + count, count * 4
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.drop("after")


def _parts(draws: DataFrame, docs: DataFrame, order: str, start: Column, stop: Column) -> DataFrame:
    """Draws once for each piece of their document that holds some of the tokens in [start, stop), with those tokens and their losses.

    Adds piece and last (whether it is the draw's last one). A draw without tokens keeps one row. Pieces are equally likely
    to be drawn, however long their documents are.
    """
    draws = draws.withColumns({"__start": start.cast("bigint"), "__stop": stop.cast("bigint")})
    end = F.floor((F.greatest(F.col("__stop"), F.col("__start") + 1) - 1) / PIECE_TOKENS)
    draws = draws.withColumn("__end", end).withColumn("piece", F.explode(F.sequence(F.floor(F.col("__start") / PIECE_TOKENS), F.col("__end"))))
    number = F.sequence(F.lit(0).cast("bigint"), F.floor((F.size("tokens") - 1) / PIECE_TOKENS))
    cut = lambda name, i: A.take(F.col(name).cast("array<int>"), i * PIECE_TOKENS, PIECE_TOKENS)
    pieces = F.transform(number, lambda i: F.struct(i.alias("piece"), cut("tokens", i).alias("tokens"), cut("loss_mask", i).alias("loss")))
    table = docs.select(order, F.explode(F.when(F.size("tokens") > 0, pieces)).alias("__p")).select(order, "__p.*")
    joined = draws.join(table, [order, "piece"], "left")
    low = F.greatest(F.col("__start") - F.col("piece") * PIECE_TOKENS, F.lit(0))
    count = F.col("__stop") - F.col("piece") * PIECE_TOKENS - low
    part = lambda name: F.coalesce(A.take(F.col(name), low, count), F.array().cast("array<int>"))
    joined = joined.withColumns({"tokens": part("tokens"), "loss": part("loss"), "last": F.col("piece") == F.col("__end")})
    return joined.drop("__start", "__stop", "__end")


def packed_sequences(
    samples: DataFrame, sample: str, docs: DataFrame, order: str, length: int, eos: int, pad: int, seed: str | int, width: int = 16_384
) -> DataFrame:
    """Fill samples of `length`+1 tokens with weighted random documents, each closed by `eos`.

    The first document of a sample starts at a random position when it is longer than the sample. `docs` has
    (order, tokens, loss_mask).
    """
    budget = length + 1
    draws = _enough_draws(samples, sample, docs, order, budget, lambda n: n + 1, seed, width)
    surplus = F.col("size") + 1 - budget
    start = F.when((F.col("draw") == 0) & (surplus > 0), hash_below(F.greatest(surplus, F.lit(0)) + 1, f"{seed}-start", sample)).otherwise(0)
    draws = draws.withColumn("from", start).withColumn("to", F.col("from") + budget - F.col("before"))
    parts = _parts(draws, docs, order, F.col("from"), F.least("to", "size"))
    closing = lambda last: F.when(F.col("last") & (F.col("to") > F.col("size")), F.array(F.lit(last))).otherwise(F.array().cast("array<int>"))
    parts = parts.withColumns({"tokens": F.concat("tokens", closing(eos)), "loss": F.concat("loss", closing(1))})
    ordered = F.sort_array(F.collect_list(F.struct("draw", "piece", "tokens", "loss")))  # at most `length`+1 tokens per sample
    grouped = parts.groupBy(sample).agg(ordered.alias("ps"))
    return grouped.select(
        sample,
        A.pad(F.flatten(F.transform("ps", lambda p: p["tokens"])), budget, pad).alias("tokens"),
        A.pad(F.flatten(F.transform("ps", lambda p: p["loss"])), budget, 0).alias("loss_mask"),
    )


def _ends_before(ends: Column, at: Column) -> Column:
    """Largest start position <= `at` that follows a sentence end; 0 if there is none."""
    return F.coalesce(F.array_max(F.filter(ends, lambda p: p + 1 <= at)) + 1, F.lit(0))


def _ends_after(ends: Column, at: Column) -> Column:
    """Smallest start position >= `at` that follows a sentence end; null if there is none."""
    return F.array_min(F.filter(ends, lambda p: p + 1 >= at)) + 1


def sentence_cut(ends: Column, size: Column, limit: Column) -> Column:
    """Length after trimming to `limit` and back to a sentence end, but never below half of the limit.

    `ends` are positions of sentence-ending tokens in the sequence to trim.
    """
    at_end = F.coalesce(F.array_max(F.filter(ends, lambda p: p + 1 <= limit)) + 1, F.lit(1))
    at_end = F.greatest(at_end, F.lit(1))
    kept = F.when(at_end < F.floor(limit / 2), limit).otherwise(at_end)
    return F.when(size > limit, kept).otherwise(size)


def block_samples(
    samples: DataFrame,
    sample: str,
    docs: DataFrame,
    order: str,
    length: int,
    cls: int,
    eos: int,
    sentence_ends: Sequence[int],
    seed: str | int,
    non_sentence_start: float = 0.0,
    width: int = 16_384,
) -> DataFrame:
    """Samples of at most `length` tokens that start and end at sentence boundaries where possible.

    A long document is entered at a random place, moved left or right (a coin flip) to a sentence start by at most half a
    sample. Short documents are strung together, each behind its own `cls`, until the sample is full.
    """
    half = length // 2
    draws = _enough_draws(samples, sample, docs, order, length, lambda n: n + 2, seed, width)
    joined = draws.withColumn("__size", F.col("size") + 1)
    long = (F.col("draw") == 0) & (F.col("__size") >= length)
    entry = hash_below(F.greatest(F.col("__size") - length + 1, F.lit(1)), f"{seed}-start", sample).cast("int")
    joined = joined.withColumns({"__long": long, "__entry": F.when(long, entry).otherwise(0)})
    # Only tokens within half a sample before the entry and one and a half behind it can matter.
    joined = joined.withColumn("__lo", F.greatest(F.col("__entry") - half - 1, F.lit(0)))
    span = 2 * half + length + 2
    fields = [sample, "draw", "before", "__size", "__long", "__entry", "__lo"]
    parts = _parts(joined.select(*fields, order, "size"), docs, order, F.col("__lo"), F.least(F.col("__lo") + span, F.col("size")))
    joined = parts.groupBy(*fields).agg(F.sort_array(F.collect_list(F.struct("piece", "tokens", "loss"))).alias("ps"))  # at most `span` tokens

    def window(name: str, last: int) -> Column:
        whole = F.col("__lo") + span >= F.col("__size")
        return F.concat(F.flatten(F.transform("ps", lambda p: p[name])), F.when(whole, F.array(F.lit(last))).otherwise(F.array().cast("array<int>")))

    joined = joined.select(*fields, window("tokens", eos).alias("tokens"), window("loss", 1).alias("loss"))
    joined = joined.withColumn("ends", F.transform(A.positions_where(F.col("tokens"), lambda x: in_ids(x, sentence_ends)), lambda p: (p + F.col("__lo")).cast("int")))
    at, size = F.col("__entry"), F.col("__size")
    left = F.greatest(_ends_before(F.col("ends"), at), at - half)
    right = F.least(F.coalesce(_ends_after(F.col("ends"), at), size), at + half, size)
    moved = F.when(hash_uniform(f"{seed}-side", sample) < 0.5, left).otherwise(right)
    moved = F.when(hash_uniform(f"{seed}-move", sample) > non_sentence_start, moved).otherwise(at)
    joined = joined.withColumn("start", F.when(F.col("__long"), moved).otherwise(0))
    # Positions shift by the cls token in front; what the sample has room for is what earlier documents left.
    joined = joined.withColumns({
        "room": F.when(F.col("__long"), F.lit(length)).otherwise(F.lit(length) - F.col("before")).cast("int"),
        "full": size - F.col("start") + 1,
        "ends": F.transform(F.filter("ends", lambda p: p >= F.col("start")), lambda p: p - F.col("start") + 1),
        "from": F.col("start") - F.col("__lo"),
    })
    kept = sentence_cut(F.col("ends"), F.col("full"), F.col("room")) - 1
    only_eos = F.col("__long") & (F.col("full") == 2)  # nothing but the closing eos is left
    none = F.array().cast("array<int>")
    part = lambda name, first: F.when(only_eos, none).otherwise(F.concat(F.array(F.lit(first)), A.take(F.col(name), F.col("from"), F.col("kept"))))
    pieces = joined.withColumn("kept", kept).select(sample, "draw", part("tokens", cls).alias("tokens"), part("loss", 0).alias("loss"))
    ordered = F.sort_array(F.collect_list(F.struct("draw", "tokens", "loss")))
    grouped = pieces.groupBy(sample).agg(ordered.alias("ps"))
    return grouped.select(
        sample, F.flatten(F.transform("ps", lambda p: p["tokens"])).alias("tokens"), F.flatten(F.transform("ps", lambda p: p["loss"])).alias("loss_mask"))


# --- sentence pairs --------------------------------------------------------------------------------------------------


def _sentence_pieces(docs: DataFrame, order: str) -> DataFrame:
    """(order, piece, sentences): PAIR_SENTENCES sentences of a document at a time, those without tokens left out."""
    full = docs.select(order, F.filter("sentences", lambda s: F.size(s) > 0).alias("__s"))
    number = F.sequence(F.lit(0).cast("bigint"), F.floor((F.size("__s") - 1) / PAIR_SENTENCES))
    cut = F.transform(number, lambda i: F.struct(i.alias("piece"), A.take(F.col("__s"), i * PAIR_SENTENCES, PAIR_SENTENCES).alias("sentences")))
    # Not a filter, which would make the sentences a second time.
    return full.select(order, F.explode(F.when(F.size("__s") > 0, cut)).alias("p")).select(order, "p.*")


class SentenceIndex:
    """Where sentences begin and end on the line of all documents' tokens. It holds sizes, not tokens."""

    def __init__(self, docs: DataFrame, order: str):
        self.order = order
        self.pieces = _sentence_pieces(docs, order)
        # Written down, so that the sums' passes over the sizes do not make the sentences again.
        sizes = cut_lineage(self.pieces.select(order, "piece", F.transform("sentences", lambda s: F.size(s)).alias("sizes")))
        total = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda n, s: n + s)
        placed = running_total(sizes.withColumn("__n", total), [order, "piece"], F.col("__n"), "lo")
        self.rows = cut_lineage(placed.select(order, "piece", "sizes", "lo", (F.col("lo") + F.col("__n")).alias("hi")))

    def documents(self) -> DataFrame:
        """(order, first, end, sentences) of documents that have some."""
        return self.rows.groupBy(self.order).agg(F.min("lo").alias("first"), F.max("hi").alias("end"), F.sum(F.size("sizes")).alias("sentences"))

    def bounds(self, rows: DataFrame, doc: str, number: str, start: str | None, stop: str | None) -> DataFrame:
        """`rows` with the tokens' places at which the numbered sentence starts and stops."""
        table = self.rows.select(F.col(self.order).alias(doc), F.col("piece").alias("__piece"), "sizes", F.col("lo").alias("__lo"))
        joined = rows.withColumn("__piece", F.floor(F.col(number) / PAIR_SENTENCES)).join(table, [doc, "__piece"])
        before = lambda n: F.col("__lo") + F.aggregate(A.head(F.col("sizes"), n), F.lit(0).cast("bigint"), lambda t, s: t + s)
        place = F.col(number) % PAIR_SENTENCES
        added = {name: before(n) for name, n in ((start, place), (stop, place + 1)) if name}
        return joined.withColumns(added).drop("__piece", "sizes", "__lo")

    def holding(self, rows: DataFrame, point: str, width: int, number: str, stop: str) -> DataFrame:
        """`rows` with the number of the sentence that holds the token at `point`, and where it stops."""
        table = self.rows.select(F.col("piece").alias("__piece"), "sizes", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
        joined = range_join(rows, point, table, "__lo", "__hi", width)
        begin = F.struct(F.col("__lo").alias("at"), F.lit(0).alias("n"))
        walked = F.aggregate("sizes", begin, lambda acc, s: F.when(acc["at"] > F.col(point), acc).otherwise(F.struct((acc["at"] + s).alias("at"), (acc["n"] + 1).alias("n"))))
        return joined.withColumn("__w", walked).withColumns({number: F.col("__piece") * PAIR_SENTENCES + F.col("__w.n") - 1, stop: F.col("__w.at")}).drop("__piece", "sizes", "__lo", "__hi", "__w")

    def tokens(self, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Tokens of `ranges` (keys, order, from, to, lo, hi): places lo to hi, in the sentences numbered from .. to."""
        numbers = F.sequence(F.floor(F.col("from") / PAIR_SENTENCES), F.floor(F.col("to") / PAIR_SENTENCES))
        parts = ranges.withColumn("piece", F.explode(numbers)).join(self.rows.select(self.order, "piece", F.col("lo").alias("__lo")), [self.order, "piece"])
        joined = parts.join(self.pieces.select(self.order, "piece", F.flatten("sentences").alias("__t")), [self.order, "piece"])
        low = F.greatest(F.col("lo") - F.col("__lo"), F.lit(0))
        part = A.take(F.col("__t"), low, F.col("hi") - F.col("__lo") - low)
        grouped = joined.select(*keys, F.struct("piece", part.alias("t")).alias("__p")).groupBy(*keys).agg(F.sort_array(F.collect_list("__p")).alias("__ps"))
        return grouped.select(*keys, F.flatten(F.transform("__ps", lambda p: p["t"])).alias("tokens"))


def _pair_starts(samples: DataFrame, sample: str, docs: DataFrame, order: str, index: SentenceIndex, seed: str | int, width: int) -> DataFrame:
    """A good start for every sample: (sample, target, order, number, lo, last, stop, num_a, is_random, pos).

    Sentences number .. last reach the target from place lo to stop; num_a of them are the first part. Whatever the documents are, at least every
    second start is good when there are two of them, so the rounds end; the starts of a single document are drawn among its good ones.
    """
    kept = docs.select(order, "weight").join(index.documents(), order)
    heads = cut_lineage(position(weight_line(kept, order, F.col("weight")).join(kept, order).drop("weight"), order, "pos"))
    found = heads.count()
    taken = F.col("last") - F.col("number") + 1

    def reached(starts: DataFrame) -> DataFrame:
        placed = index.bounds(starts, order, "number", "lo_a", None)
        placed = placed.withColumn("__point", F.least(F.col("lo_a") + F.col("target"), F.col("end")) - 1)
        return index.holding(placed, "__point", width, "last", "stop").drop("__point")

    columns = [sample, "target", order, "number", F.col("lo_a").alias("lo"), "last", "stop", "num_a", "is_random", "pos"]
    if found < 2:
        follows = index.rows.select(order, "piece", F.posexplode("sizes").alias("__i", "__size")).join(heads, order)
        follows = follows.withColumn("number", F.col("piece") * PAIR_SENTENCES + F.col("__i")).filter(F.col("number") < F.col("sentences") - 1)
        ranked = position(follows.select(order, "number", "__size", "end", "pos"), ["__size", "number"], "__rank")
        # A row for each length of target: how many sentences leave room for another one.
        sizes = follows.groupBy("__size").count()
        lengths = samples.select("target").distinct()
        room = lengths.join(sizes, F.col("__size") < F.col("target"), "left").groupBy("target").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("__room"))
        if not room.filter("__room = 0").isEmpty():
            raise ValueError("sentence pairs need two documents, or one with two sentences in reach of each other")
        drawn = samples.join(F.broadcast(room), "target").withColumn("__rank", hash_below(F.col("__room"), f"{seed}-a", sample, F.lit(0)))
        drawn = reached(drawn.join(ranked, "__rank"))
        cut = 1 + hash_below(taken - 1, f"{seed}-cut", sample, F.lit(0))
        return drawn.withColumns({"num_a": cut.cast("int"), "is_random": F.lit(False)}).select(*columns)
    waiting, parts, attempt = samples, [], 0
    while True:
        tries = waiting.withColumn("__try", F.explode(F.sequence(F.lit(attempt), F.lit(attempt + PAIR_TRIES - 1))))
        drawn = weighted_draws(tries, [sample, "__try"], heads, seed, width)
        drawn = reached(drawn.withColumn("number", hash_below(F.col("sentences"), f"{seed}-a", sample, "__try")))
        drawn = drawn.withColumns({
            "num_a": F.when(taken >= 2, hash_below(taken + 1, f"{seed}-cut", sample, "__try")).otherwise(1).cast("int"),
            "is_random": (taken == 1) | (hash_uniform(f"{seed}-next", sample, "__try") < 0.5)})
        good = drawn.filter((F.col("num_a") >= 1) & (F.col("is_random") | (F.col("num_a") < taken)))
        chosen = cut_lineage(good.groupBy(sample).agg(F.min_by(F.struct(*columns[1:]), "__try").alias("__c"), F.min("__try").alias("__try")).select(sample, "__c.*", "__try"))
        parts.append(chosen)
        waiting = cut_lineage(waiting.join(chosen.select(sample), sample, "left_anti"))
        if waiting.isEmpty():
            break
        attempt += PAIR_TRIES
    return reduce(DataFrame.unionByName, parts)


def sentence_pairs(
    samples: DataFrame, sample: str, docs: DataFrame, order: str, length: int, seed: str | int, short_prob: float = 0.01, width: int = 16_384
) -> DataFrame:
    """Pairs of texts for next-sentence prediction: (sample, is_random, tokens_a, tokens_b).

    `docs` has (order, weight, sentences array<array<int>>); sentences without tokens are left out. A pair starts at a random sentence of
    a weighted document; its second part is the continuation, or a passage of another document half of the time. Pairs with
    an empty part are drawn again; a single document that holds no pair is an error. Draws work on an index of
    sentence sizes; only the pieces of documents that a chosen pair needs are joined.
    """
    short = hash_uniform(f"{seed}-short", sample) < short_prob
    target = F.when(short, 2 + hash_below(length - 1, f"{seed}-length", sample)).otherwise(length).cast("int")
    index = SentenceIndex(docs, order)
    starts = _pair_starts(samples.select(sample, target.alias("target")), sample, docs, order, index, seed, width)
    if "__try" not in starts.columns:
        starts = starts.withColumn("__try", F.lit(0))
    starts = index.bounds(starts.withColumn("to_a", F.col("number") + F.col("num_a") - 1), order, "to_a", None, "hi_a")
    first = starts.select(sample, F.lit("a").alias("side"), order, F.col("number").alias("from"), F.col("to_a").alias("to"), "lo", F.col("hi_a").alias("hi"))
    following = starts.filter(~F.col("is_random")).select(
        sample, F.lit("b").alias("side"), order, (F.col("to_a") + 1).alias("from"), F.col("last").alias("to"), F.col("hi_a").alias("lo"), F.col("stop").alias("hi"))
    heads = position(index.documents(), order, "__other")
    total = heads.agg(F.count("*").alias("__n"))  # one row
    other = starts.filter("is_random").drop(order).crossJoin(F.broadcast(total))
    pick = hash_below(F.greatest(F.col("__n") - 1, F.lit(1)), f"{seed}-other", sample, "__try")
    other = other.withColumn("__other", pick + F.when(pick >= F.col("pos"), 1).otherwise(0)).join(heads.select("__other", order, "end", "sentences"), "__other")
    other = index.bounds(other.withColumn("from", hash_below(F.col("sentences"), f"{seed}-b", sample, "__try")), order, "from", "lo_b", None)
    need = F.greatest(F.col("target") - (F.col("hi_a") - F.col("lo")), F.lit(1))
    other = index.holding(other.withColumn("__point", F.least(F.col("lo_b") + need, F.col("end")) - 1), "__point", width, "to", "hi")
    random = other.select(sample, F.lit("b").alias("side"), order, "from", "to", F.col("lo_b").alias("lo"), "hi")
    ranges = cut_lineage(first.unionByName(following).unionByName(random))
    texts = index.tokens(ranges, [sample, "side"])
    sides = texts.groupBy(sample).agg(*[F.max(F.when(F.col("side") == side, F.col("tokens"))).alias(f"tokens_{side}") for side in "ab"])
    return starts.select(sample, "is_random").join(sides, sample)


def pair_losses(size_a: Column, size_b: Column, limit: int | Column) -> tuple[Column, Column]:
    """How many tokens each side loses when the longer side (the second on a tie) gives up one token at a time."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    surplus = F.greatest(size_a + size_b - limit, F.lit(0))
    level = F.least(surplus, F.abs(size_a - size_b))
    shared = surplus - level
    loss_a = F.when(size_a > size_b, level).otherwise(0) + F.floor(shared / 2)
    return loss_a.cast("int"), (surplus - loss_a).cast("int")


def truncate_pair(
    df: DataFrame, key: str, limit: int, seed: str | int, size: Callable[[Column], Column] = F.size, take: Callable[[Column, Column, Column], Column] = A.take
) -> DataFrame:
    """Cut `tokens_a` and `tokens_b` to `limit` tokens together; each lost token goes from the front or the back by a coin flip.

    `size` and `take` are for tokens in another form than arrays, such as texts whose characters are the tokens.
    """
    sizes = {side: size(F.col(f"tokens_{side}")) for side in "ab"}
    losses = dict(zip("ab", pair_losses(sizes["a"], sizes["b"], limit)))

    def cut(side: str) -> Column:
        return take(F.col(f"tokens_{side}"), heads(losses[side], f"{seed}-{side}", key), sizes[side] - losses[side])

    return df.withColumns({f"tokens_{side}": cut(side) for side in "ab"})


# --- evaluation windows ----------------------------------------------------------------------------------------------


def _as_is(array: Column) -> Column:
    return array


def sliding_windows(
    docs: DataFrame, keys: Sequence[str], length: int, stride: int, pad: int | str = 0, form: Callable[[Column], Column] = _as_is
) -> DataFrame:
    """Overlapping windows of `length` tokens every `stride`; each token is scored once.

    The first window scores all of its tokens, later ones only their last `stride` positions. `form` says how a row holds an array, for
    instance as text; the mask that nearly all windows share is put in form only once.
    """
    over = F.greatest(F.size("tokens") - length, F.lit(0))
    count = F.ceil(over / stride).cast("int") + 1
    # Only the numbers are exploded: the slices of a window are compiled with the explode, and no row with a whole document is written.
    numbered = docs.select(*keys, "tokens", F.explode(A.counting(0, count)).alias("window"))
    windows = numbered.select(*keys, "window", A.take(F.col("tokens"), F.col("window") * stride, length).alias("tokens"))
    size, shown = F.size("tokens"), max(length - stride, 0)
    scored = A.pad(A.repeat(1, size), length, 0)
    full = F.concat(A.repeat(0, F.lit(shown)), A.repeat(1, F.lit(length - shown)))  # a constant
    late = F.concat(A.repeat(0, F.lit(shown)), A.repeat(1, size - shown), A.repeat(0, length - size))
    mask = F.when(F.col("window") == 0, form(scored)).when(size == length, form(full)).otherwise(form(late))
    padded = F.when(size < length, form(A.pad(F.col("tokens"), length, pad))).otherwise(form(F.col("tokens")))
    return windows.select(*keys, "window", padded.alias("tokens"), mask.alias("loss_mask"))


def stream_windows(
    docs: DataFrame, order: str, length: int, stride: int, pad: int = 0, encode: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The windows of `sliding_windows` over the concatenation of all documents, as of one file: (window, tokens, loss_mask).

    Pieces of documents meet their place and go to every block of BLOCK_WINDOWS windows that reaches into them, so a block gets its halo from
    whatever tasks read the documents around it, and a token moves about once, not once for each of its windows. With `encode` the tokens are
    texts (see Form).
    """
    form = Form(encode)
    sizes, places = _stream_places(docs, order, PIECE_TOKENS, form)
    cut = docs.select(order, F.posexplode(form.pieces(F.col("tokens"), PIECE_TOKENS)).alias("__k", "tokens"))
    pieces = cut.withColumn("__k", F.col("__k").cast("bigint")).join(places, [order, "__k"])
    pieces = pieces.select((F.col("__lo") + F.col("__k") * PIECE_TOKENS).alias("lo"), "tokens")
    total = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total"))  # one row
    last = F.ceil(F.greatest(F.col("__total") - length, F.lit(0)) / stride)
    step, reach = BLOCK_WINDOWS * stride, (BLOCK_WINDOWS - 1) * stride + length  # from block to block, and of one block
    first = F.greatest(F.floor((F.col("lo") - reach) / step) + 1, F.lit(0))
    final = F.least(F.floor((F.col("lo") + form.size(F.col("tokens")) - 1) / step), F.floor(last / BLOCK_WINDOWS))
    reached = pieces.crossJoin(F.broadcast(total)).filter(first <= final).select("lo", "tokens", F.explode(F.sequence(first, final)).alias("block"))
    begin = F.greatest(F.col("block") * step - F.col("lo"), F.lit(0))
    part = form.take(F.col("tokens"), begin, F.col("block") * step + reach - F.col("lo") - begin)
    # A block holds at most `reach` tokens, so its group is bounded.
    grouped = reached.groupBy("block").agg(F.sort_array(F.collect_list(F.struct((F.col("lo") + begin).alias("lo"), part.alias("t")))).alias("ps"))
    blocks = grouped.select("block", form.ids(form.joined(F.transform("ps", lambda p: p["t"]))).alias("b")).crossJoin(F.broadcast(total))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(BLOCK_WINDOWS - 1).cast("bigint"), last - F.col("block") * BLOCK_WINDOWS))
    numbered = blocks.select("block", "b", F.explode(numbers).alias("i"))
    windows = numbered.select((F.col("block") * BLOCK_WINDOWS + F.col("i")).alias("window"), A.take(F.col("b"), F.col("i") * stride, length).alias("t"))
    scored = A.pad(A.repeat(1, F.size("t")), length, 0)
    late = F.concat(A.repeat(0, F.lit(length - stride)), A.drop(scored, length - stride))
    return windows.select("window", A.pad(F.col("t"), length, pad).alias("tokens"), F.when(F.col("window") == 0, scored).otherwise(late).alias("loss_mask"))


def blank_windows(docs: DataFrame, keys: Sequence[str], length: int, stride: int) -> DataFrame:
    """The same windows as prompt and text: a later window shows its first length-stride tokens and asks for the rest."""
    count = F.ceil(F.greatest(F.size("tokens") - length, F.lit(0)) / stride).cast("int") + 1

    def window(number: Column) -> Column:
        tokens = A.take(F.col("tokens"), number * stride, length)
        shown = F.when(number == 0, F.lit(1)).otherwise(F.lit(length - stride))
        return F.struct(number.alias("window"), A.head(tokens, shown).alias("prompt"), A.drop(tokens, shown).alias("text"))

    return docs.select(*keys, F.explode(F.transform(A.counting(0, count), window)).alias("w")).select(*keys, "w.*")


def last_word_cloze(text: Column) -> Column:
    """Everything before the last word as context, the last word as answer."""
    pattern = r"(?s)^(.*?)(\S+)\s*$"
    context = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"^\s+|\s+$", "")
    return F.struct(context.alias("context"), F.regexp_extract(text, pattern, 2).alias("answer"))


def last_token_cloze(tokens: Column) -> Column:
    """Everything before the last token as context, the last token as answer; null where there is none."""
    return F.struct(A.head(tokens, F.size(tokens) - 1).alias("context"), F.get(tokens, F.size(tokens) - 1).alias("answer"))


def passage_windows(df: DataFrame, keys: Sequence[str], max_source: int, answer_required: bool = False) -> DataFrame:
    """Windows over a context, labelled with the answer if it occurs in them and `N/A` otherwise.

    `df` has `context` (text), `question_size` and `answer`; sizes are characters. Windows start every half source length and
    stop behind the first one that reaches past the end. When an answer is required, windows without it are skipped, and a
    skipped window does not stop the walk.
    """
    width = F.lit(max_source - 3) - F.col("question_size")
    step = max_source // 2
    starts = F.transform(A.counting(0, F.ceil(F.length("context") / step).cast("int")), lambda i: i * step)

    def window(start: Column) -> Column:
        text = F.col("context").substr(start + 1, width)
        found = (F.col("answer") != "") & F.contains(text, F.col("answer"))
        return F.struct(start.alias("start"), text.alias("text"), found.alias("found"), (F.length(text) < width).alias("short"))

    df = df.withColumn("__ws", F.transform(starts, window))
    if answer_required:
        df = df.withColumn("__ws", F.filter("__ws", lambda w: w["found"]))
    stop = F.array_min(F.transform(F.filter("__ws", lambda w: w["short"]), lambda w: w["start"]))
    df = df.withColumn("__stop", stop)
    kept = F.filter("__ws", lambda w: F.col("__stop").isNull() | (w["start"] <= F.col("__stop")))
    rows = df.select(*keys, "answer", F.explode(kept).alias("w"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.text").alias("text"), F.when(F.col("w.found"), F.col("answer")).otherwise("N/A").alias("label"))


def sections(lines: DataFrame, key: str) -> DataFrame:
    """Group the lines of an article into (key sentence, content) sections.

    `lines` has (key, line_no, sentences). A line of several sentences opens a section. Single-sentence lines in a row are a
    heading and its content; a heading without content joins the section before it, if there is one.
    """
    many = (F.size("sentences") > 1).cast("int")
    island = F.sum(many).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = lines.filter(F.size("sentences") > 0).withColumn("island", island).groupBy(key, "island").agg(
        F.max(F.when(F.size("sentences") > 1, F.col("sentences"))).alias("opening"),
        F.sort_array(F.collect_list(F.when(F.size("sentences") == 1, F.struct("line_no", F.col("sentences")[0].alias("s"))))).alias("singles"),
    )
    islands = islands.withColumn("singles", F.transform("singles", lambda x: x["s"]))
    joins_opening = (F.size("singles") == 1) & F.col("opening").isNotNull()
    opened = F.struct(
        F.col("opening")[0].alias("key_sentence"),
        F.concat(A.drop(F.col("opening"), 1), F.when(joins_opening, F.col("singles")).otherwise(F.array().cast("array<string>"))).alias("content"),
    )
    headed = F.struct(F.col("singles")[0].alias("key_sentence"), A.drop(F.col("singles"), 1).alias("content"))
    both = F.array(
        F.when(F.col("opening").isNotNull(), opened),
        F.when((F.size("singles") > 0) & ~joins_opening, headed),
    )
    rows = islands.select(key, "island", F.posexplode(both).alias("part", "s")).filter(F.col("s").isNotNull())
    return rows.select(key, (F.col("island") * 2 + F.col("part")).alias("section"), F.col("s.key_sentence"), F.array_join("s.content", " ").alias("content"))


def around_answer(source: Column, pattern: Column, limit: int | Column) -> Column:
    """At most `limit` tokens around the first occurrence of the answer; the head when it does not occur."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    found = F.get(A.sublist_positions(source, pattern), F.lit(0))
    start = F.when(found.isNull(), F.lit(0)).otherwise(F.greatest(found - F.floor(limit / 2), F.lit(0)))
    return F.when(F.size(source) > limit, A.take(source, start, limit)).otherwise(source)


def pad_batch(df: DataFrame, batch: str, column: str, pad: int) -> DataFrame:
    """Pad to the longest sequence of the batch; a batch is a fixed number of rows."""
    longest = F.max(F.size(column)).over(Window.partitionBy(batch))
    return df.withColumn("__longest", longest).withColumn(column, A.pad(F.col(column), F.col("__longest"), pad)).drop("__longest")


def segments(tokens: Column, eos: int) -> Column:
    """Segment number and position inside the segment of every token; a segment ends with its eos."""
    # One entry per segment, so the work is linear: [first token, first token of the next segment).
    def spread(starts: Column, size: Column) -> Column:
        return F.flatten(F.transform(starts, lambda first, k: A.let(
            F.coalesce(F.get(starts, k + 1), size) - first,
            lambda count: F.transform(A.counting(0, count), lambda j: F.struct(k.cast("int").alias("segment"), j.cast("int").alias("position"))))))

    ends = F.transform(A.positions_where(tokens, lambda x: x == eos), lambda i: i + 1)
    return A.let(F.concat(F.array(F.lit(0)), ends), lambda starts: A.let(F.size(tokens), lambda size: spread(starts, size)))
