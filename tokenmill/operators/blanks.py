"""Masked and blank-filling training examples from `samples(sample, batch, tokens, loss_mask)`.

A sample is one training sequence, so everything about it is decided inside its row: span lengths, places and order are hashes
of the sample key, and the layouts are built by array expressions. Only decisions shared by a batch need a window, and a
batch is a fixed number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions import arrays as A
from tokenmill.functions.hashing import first_above, hash_below, hash_hex, hash_uniform, hashes_of
from tokenmill.operators.special import Special

NO_INTS = "array<int>"
SPANS = "array<struct<start:int,end:int>>"


def _none(kind: str = NO_INTS) -> Column:
    return F.array().cast(kind)


def _int_share(share: float, size: Column) -> Column:
    return F.floor(F.lit(float(share)) * size).cast("int")


# --- decisions -------------------------------------------------------------------------------------------------------


def objective(batch: str, seed: str | int, bert_prob: float, sentence_prob: float, single_span_prob: float = 0.0) -> Column:
    """Objective of a batch: token blanks, sentence blanks or generation; a single-span batch always blanks tokens."""
    single = hash_uniform(f"{seed}-single", batch) < single_span_prob
    draw = F.when(single, F.lit(0.0)).otherwise(hash_uniform(f"{seed}-objective", batch))
    mode = F.when(draw < bert_prob, "bert").when(draw < bert_prob + sentence_prob, "sentence").otherwise("gpt")
    return F.struct(mode.alias("mode"), single.alias("single_span"))


def span_length_cdf(mean: float = 3.0, max_length: int = 40) -> list[float]:
    """Cumulative share of the span lengths 1..max_length-1 under a Poisson law."""
    weights = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(1, max_length)]
    total, running, cdf = sum(weights), 0.0, []
    for weight in weights:
        running += weight
        cdf.append(running / total)
    return cdf


def span_lengths(key: str, size: Column, ratio: float, seed: str | int, cdf: Sequence[float], single: Column | None = None) -> Column:
    """Random span lengths until they cover int(ratio * size) tokens; the last one may reach beyond. One length if `single`."""
    target = _int_share(ratio, size)
    start = F.struct(F.lit(0).alias("total"), _none().alias("lengths"))
    length = lambda i: first_above(hash_hex(seed, key, i), cdf[:-1]) + 1

    def draw(acc: Column, i: Column) -> Column:
        grown = A.let(length(i), lambda n: F.struct((acc["total"] + n).alias("total"), F.array_append(acc["lengths"], n).alias("lengths")))
        return F.when(acc["total"] >= target, acc).otherwise(grown)

    many = F.aggregate(A.counting(0, target), start, draw)["lengths"]
    if single is None:
        return many
    return F.when(single, F.array(length(F.lit(0)))).otherwise(many)


def place_spans(lengths: Column, total: Column, offset: Column, seed: str | int, *keys) -> Column:
    """Random spans of the given lengths that keep a gap of at least one token, inside [offset, offset + total)."""
    def placed(v: Column) -> Column:
        room = F.greatest(v["total"] - F.aggregate(v["ls"], F.lit(0), lambda acc, x: acc + x) - F.size(v["ls"]) + 2, F.lit(1))
        places = F.sort_array(F.transform(v["ls"], lambda _, i: hash_below(room, seed, *keys, i).cast("int")))
        ends = A.running_sums(F.transform(v["ls"], lambda n: n + 1))
        return A.let(F.struct(places.alias("p"), ends.alias("e"), v["ls"].alias("ls"), v["offset"].alias("o")), lambda w: F.transform(
            w["ls"],
            lambda n, i: F.struct(
                (w["o"] + w["p"][i] + w["e"][i] - n - 1).cast("int").alias("start"),
                (w["o"] + w["p"][i] + w["e"][i] - 1).cast("int").alias("end"),
            ),
        ))

    return A.let(F.struct(lengths.alias("ls"), total.cast("int").alias("total"), offset.cast("int").alias("offset")), placed)


def document_ranges(tokens: Column, eos: int, cls: int) -> Column:
    """(length, offset) of the documents inside a sample, shortest first, the later one first among equals.

    The leading cls belongs to no document, an eos closes one, and the last token of the sample is never blanked.
    """
    def ranges(v: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(A.positions_where(v, lambda x: x == eos), lambda i: i + 1))
        starts = F.filter(starts, lambda s: s <= F.size(v))
        return A.let(starts, lambda ss: F.sort_array(
            F.transform(ss, lambda s, k: A.let(
                F.struct(
                    (s + F.when(F.get(v, s) == cls, 1).otherwise(0)).cast("int").alias("begin"),
                    F.coalesce(F.get(ss, k + 1) - 1, F.size(v)).cast("int").alias("stop"),
                    F.get(ss, k + 1).isNull().alias("last"),
                ),
                lambda d: A.let(d["stop"] - d["begin"], lambda n: F.struct(
                    (n - F.when(d["last"] & (n > 0), 1).otherwise(0)).cast("int").alias("length"),
                    (-d["begin"]).alias("minus_offset"),
                )),
            )),
        ))

    return A.let(tokens, ranges)


def spread_spans(key: str, tokens: Column, lengths: Column, ratio: float, eos: int, cls: int, seed: str | int) -> Column:
    """Spans of the given lengths over the documents of a sample.

    Documents are filled from the shortest; each takes the next lengths up to int(length * ratio), the longest takes what
    still fits with gaps. Fewer spans than lengths come back when they do not all fit.
    """
    def fill(v: Column) -> Column:
        def step(acc: Column, d: Column, rank: Column, n_docs: Column) -> Column:
            used = F.when(acc["taken"] > 0, F.get(v["sums"], acc["taken"] - 1)).otherwise(F.lit(0))
            rest = A.drop(v["sums"], acc["taken"])
            is_last = rank == n_docs - 1
            limit = F.when(is_last, d["length"]).otherwise(_int_share(ratio, d["length"]))
            count = A.let(used, lambda u: F.size(F.filter(rest, lambda s, i: s - u + F.when(is_last, i).otherwise(0) <= limit)))
            return A.let(count, lambda c: F.struct(
                (acc["taken"] + c).cast("int").alias("taken"),
                F.concat(acc["spans"], place_spans(A.take(v["ls"], acc["taken"], c), d["length"], -d["minus_offset"], seed, key, rank)).alias("spans"),
            ))

        begin = F.struct(F.lit(0).alias("taken"), _none(SPANS).alias("spans"))
        numbered = F.transform(v["docs"], lambda d, k: F.struct(d.alias("d"), k.alias("k")))
        return F.aggregate(numbered, begin, lambda acc, x: step(acc, x["d"], x["k"], F.size(v["docs"])))["spans"]

    return A.let(
        F.struct(lengths.alias("ls"), A.running_sums(lengths).alias("sums"), document_ranges(tokens, eos, cls).alias("docs")), fill)


def sentence_spans(key: str, tokens: Column, sentence_ends: Sequence[int], eos: int, cls: int, ratio: float, seed: str | int) -> Column:
    """Random whole sentences until they cover int(ratio * size) tokens; at least one."""
    def spans(v: Column) -> Column:
        bounds = A.positions_where(v, lambda x: x.isin(list(sentence_ends)) | (x == eos))
        first = F.when(F.get(v, F.lit(0)) == cls, 1).otherwise(0)
        return A.let(bounds, lambda bs: F.concat(
            F.filter(
                F.transform(bs, lambda b, k: F.when(
                    v[b] != eos, F.struct(F.when(k == 0, first).otherwise(F.get(bs, k - 1) + 1).cast("int").alias("start"), (b + 1).cast("int").alias("end")))),
                lambda s: s.isNotNull() & (s["start"] < s["end"]),
            ),
            F.filter(
                F.array(F.struct(F.coalesce(F.element_at(F.when(F.size(bs) > 0, bs), -1) + 1, first).cast("int").alias("start"), F.size(v).cast("int").alias("end"))),
                lambda s: s["start"] < s["end"],
            ),
        ))

    def chosen(v: Column) -> Column:
        ordered = F.sort_array(F.transform(v["spans"], lambda s: F.struct(hash_hex(seed, key, s["start"]).alias("h"), s.alias("s"))))
        begin = F.struct(F.lit(0).alias("total"), _none(SPANS).alias("spans"))
        target = _int_share(ratio, v["size"])
        return F.aggregate(ordered, begin, lambda acc, x: F.when((F.size(acc["spans"]) > 0) & (acc["total"] >= target), acc).otherwise(
            F.struct((acc["total"] + x["s"]["end"] - x["s"]["start"]).cast("int").alias("total"), F.concat(acc["spans"], F.array(x["s"])).alias("spans"))))["spans"]

    return A.let(F.struct(A.let(tokens, spans).alias("spans"), F.size(tokens).alias("size")), chosen)


# --- layouts ---------------------------------------------------------------------------------------------------------


def _smallest(hashes: Column, count: Column) -> Column:
    """Boolean per element: whether its hash is among the `count` smallest."""
    kth = lambda hs: F.get(F.sort_array(hs), F.greatest(count, F.lit(0)) - 1)
    return A.let(hashes, lambda hs: A.let(kth(hs), lambda last: F.transform(hs, lambda h: last.isNotNull() & (h <= last))))


def _numbers(count: Column, seed: str | int, key: str) -> Column:
    """Distinct random numbers for the places of a row: four of 32 bits from each digest, each with its place behind it."""
    digests = F.transform(A.indices(A.repeat(0, F.ceil(count / 4))), lambda b: hash_hex(seed, key, b))
    parts = F.flatten(F.transform(digests, lambda d: F.array(*[F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])))
    return F.transform(A.head(parts, count), lambda n, i: n * (1 << 24) + i)


def blank_layout(
    df: DataFrame,
    key: str,
    special: Special,
    seed: str | int,
    mask_id: int | None = None,
    shuffle: bool = True,
    sentinels: bool = False,
    max_length: int | None = None,
    random_position: bool = False,
    block_positions: bool = True,
    span_corruption: float = 0.0,
    context_corruption: float = 0.0,
    context_range: int = 3,
) -> DataFrame:
    """Blank-filling layout of `tokens` with `spans(start, end)`.

    The source is the text with one mask per span. Behind it every span follows, in random order, as `sop` and its tokens;
    the targets there are the span's tokens and `eop`. Positions count along the source and repeat the mask's position
    inside its span; block positions count inside a span. Loss is on the spans only, and `sep` is the source length.
    """
    mask_id = special.mask if mask_id is None else mask_id

    def rank(s: Column) -> Column:
        return hash_hex(f"{seed}-order", key, s["start"]) if shuffle else F.lpad(s["start"].cast("string"), 12, "0")

    def placed(v: Column) -> Column:
        # How much shorter the source gets by each span and those before it.
        shrink = A.running_sums(F.transform(v, lambda s: s["end"] - s["start"] - 1))
        return A.let(shrink, lambda less: F.transform(v, lambda s, k: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.when(k == 0, F.lit(0)).otherwise(F.get(v, k - 1)["end"]).alias("before"),
            (s["start"] - F.when(k == 0, F.lit(0)).otherwise(F.get(less, k - 1))).cast("int").alias("at"),
            rank(s).alias("rank"),
        )))

    df = df.withColumn("__by_place", A.let(F.sort_array("spans"), placed))
    by_rank = F.sort_array(F.transform("__by_place", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["at"].alias("at"))))
    df = df.withColumn("__by_rank", by_rank)
    tokens = F.col("tokens")

    if sentinels:
        masks, sops = (F.array(*map(F.lit, ids)) for ids in (special.sentinel_mask, special.sentinel_sop))
        mask_of = lambda s: A.let(F.array_position(F.transform("__by_rank", lambda r: r["start"]), s["start"]), lambda p: F.element_at(masks, p.cast("int")))
        sop_of = lambda k: F.element_at(sops, k + 1)
    else:
        mask_of = lambda s: F.lit(mask_id)
        sop_of = lambda k: F.lit(special.sop)

    last_end = F.coalesce(F.get("__by_place", F.size("__by_place") - 1)["end"], F.lit(0))
    source = F.concat(
        A.let(A.plain(tokens), lambda ts: A.flat_pairs(F.transform("__by_place", lambda s: F.array(A.take(ts, s["before"], s["start"] - s["before"]), F.array(mask_of(s)))))),
        A.drop(tokens, last_end),
    )
    df = df.withColumn("__source", source)
    df = df.withColumn("sep", F.size("__source"))
    bias = F.lit(0)
    if random_position:
        free = F.lit(max_length) - (F.col("sep") - 1)
        bias = F.when(F.col("sep") - 1 < max_length - 1, hash_below(F.greatest(free, F.lit(1)), f"{seed}-bias", key).cast("int")).otherwise(0)
    df = df.withColumn("__bias", bias)

    def span(ts: Column, s: Column) -> Column:
        return A.take(ts, s["start"], s["end"] - s["start"])

    def shown(ts: Column, s: Column) -> Column:
        if span_corruption <= 0:
            return span(ts, s)
        return F.transform(span(ts, s), lambda x, j: F.when(hash_uniform(f"{seed}-span", key, s["start"] + j) < span_corruption, special.dblock).otherwise(x))

    def size(s: Column) -> Column:
        return s["end"] - s["start"] + 1

    visible = F.col("__source")
    if context_corruption > 0:
        # Segments of the source between masks; candidates lie next to a segment border, except the very first one.
        cuts = F.concat(F.transform("__by_place", lambda s: s["at"]), F.filter(F.array(F.col("sep")), lambda n: last_end < F.size("tokens")))
        segments = A.let(cuts, lambda cs: F.transform(cs, lambda c, k: F.struct(F.when(k == 0, F.lit(0)).otherwise(F.get(cs, k - 1) + 1).alias("b"), c.alias("e"))))

        def candidates(g: Column) -> Column:
            """Places behind the border at a segment's start, then those before the one at its end, each once and ascending."""
            behind = F.when(g["b"] != 0, F.least(g["e"], g["b"] + context_range)).otherwise(g["b"])
            return A.let(F.struct(g["b"].alias("b"), g["e"].alias("e"), behind.alias("f")), lambda v: F.array(
                A.counting(v["b"], v["f"] - v["b"]),
                A.let(F.greatest(v["f"], v["e"] - context_range), lambda before: F.when(v["e"] != 0, A.counting(before, v["e"] - before)).otherwise(_none()))))

        df = df.withColumn("__near", A.flat_pairs(F.transform(segments, candidates)))
        picked = A.let(
            _smallest(hashes_of(F.col("__near"), f"{seed}-context", key), _int_share(context_corruption, F.size("tokens"))),
            lambda flags: F.filter("__near", lambda p, k: F.get(flags, k)))
        # What lies between the picked places is copied as it is.
        places = F.struct(F.concat(F.array(F.lit(-1)), picked).alias("p"), A.plain(F.col("__source")).alias("s"))
        visible = A.let(places, lambda v: A.flat_pairs(F.transform(v["p"], lambda p, k: F.array(
            F.when(k == 0, _none()).otherwise(F.array(F.lit(special.dblock))),
            A.take(v["s"], p + 1, F.coalesce(F.get(v["p"], k + 1), F.col("sep")) - p - 1)))))

    def position(s: Column) -> Column:
        return F.lit(max_length) if sentinels else s["at"] + F.col("__bias")

    counted = lambda s: A.counting(1, size(s)) if block_positions else A.repeat(1, size(s))
    held = A.plain(tokens)
    return df.withColumns({
        "text": F.concat(visible, A.let(held, lambda ts: A.flat_pairs(F.transform("__by_rank", lambda s, k: F.array(F.array(sop_of(k)), shown(ts, s)))))),
        "target": F.concat("__source", A.let(held, lambda ts: A.flat_pairs(F.transform("__by_rank", lambda s: F.array(span(ts, s), F.array(F.lit(special.eop))))))),
        "position": F.concat(
            F.transform(A.indices(F.col("__source")), lambda i: (i + F.col("__bias")).cast("int")),
            F.flatten(F.transform("__by_rank", lambda s: A.repeat(position(s).cast("int"), size(s))))),
        "block_position": F.concat(A.repeat(0, F.col("sep")), F.flatten(F.transform("__by_rank", counted))),
        "loss_mask": F.concat(A.repeat(0, F.col("sep")), F.flatten(F.transform("__by_rank", lambda s: A.repeat(1, size(s))))),
    }).drop("__by_place", "__by_rank", "__source", "__bias", "__near")


def encoder_decoder_layout(df: DataFrame, special: Special) -> DataFrame:
    """Masked source and, as a second sequence, all spans in text order behind their `sop`, closed by one `eop`."""
    df = df.withColumn("__by_place", F.sort_array("spans"))
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("__by_place", k - 1)["end"])
    tokens = F.col("tokens")
    source = F.concat(
        F.flatten(F.transform("__by_place", lambda s, k: F.concat(A.take(tokens, before(k), s["start"] - before(k)), F.array(F.lit(special.mask))))),
        A.drop(tokens, F.coalesce(F.get("__by_place", F.size("__by_place") - 1)["end"], F.lit(0))),
    )
    target = F.flatten(F.transform("__by_place", lambda s: F.concat(F.array(F.lit(special.sop)), A.take(tokens, s["start"], s["end"] - s["start"]))))
    target = F.concat(target, F.array(F.lit(special.eop)))
    df = df.withColumns({"source": source, "target": target})
    return df.withColumn("loss_mask", A.repeat(1, F.size("target"))).drop("__by_place")


def masked_layout(df: DataFrame, special: Special) -> DataFrame:
    """Masks in place: tokens inside spans become the mask, targets are the text, loss is inside the spans."""
    inside = A.let(F.col("spans"), lambda spans: F.transform(
        A.indices(F.col("tokens")), lambda i: F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"]))))
    df = df.withColumn("__in", inside)
    return df.withColumns({
        "text": F.transform("tokens", lambda x, i: F.when(F.get("__in", i), special.mask).otherwise(x)),
        "target": F.col("tokens"),
        "loss_mask": F.transform(F.col("loss_mask").cast("array<int>"), lambda x, i: F.when(F.get("__in", i), x).otherwise(0)),
        "position": A.indices(F.col("tokens")),
    }).drop("__in")


def token_blanks(df: DataFrame, key: str, special: Special, seed: str | int, ratio: float = 0.15, cdf: Sequence[float] | None = None) -> DataFrame:
    """Add random token spans; samples that cannot hold all of their spans are dropped."""
    df = df.withColumn("lengths", span_lengths(key, F.size("tokens"), ratio, f"{seed}-length", cdf or span_length_cdf()))
    spread = spread_spans(key, F.col("tokens"), F.col("lengths"), ratio, special.eos, special.cls, f"{seed}-place")
    # Not a filter on the spans, below which Spark would make lengths and spans again for each of their uses.
    whole = A.let(F.struct(spread.alias("s"), F.size("lengths").alias("n")), lambda v: F.when(F.size(v["s"]) == v["n"], F.array(v["s"])))
    kept = [c for c in df.columns if c not in ("lengths", "spans")]
    return A.exploded(df, kept, whole, "spans")


def generation_layout(
    df: DataFrame, key: str, batch: str, special: Special, seed: str | int, min_ratio: float = 0.5, infill_prob: float = 0.5, block_positions: bool = True
) -> DataFrame:
    """Generate the end of the sample, or one long span inside it.

    The generated length is drawn once per batch and is at most size - 2. Samples of several documents always generate
    their end; the others fill a span with probability 1 - `infill_prob`.
    """
    w = Window.partitionBy(batch)
    shortest, longest = F.min(F.size("tokens")).over(w), F.max(F.size("tokens")).over(w)
    df = df.withColumns({"__lo": _int_share(min_ratio, shortest), "__hi": longest - 2})
    drawn = F.col("__lo") + hash_below(F.greatest(F.col("__hi") - F.col("__lo") + 1, F.lit(1)), f"{seed}-length", batch)
    df = df.withColumn("__count", F.least(drawn, F.size("tokens") - 2).cast("int"))
    first_eos = A.first_index(F.col("tokens"), special.eos)
    several = ~((first_eos == -1) | (first_eos == F.size("tokens") - 1))
    df = df.withColumn("suffix", several | (hash_uniform(f"{seed}-infill", key) < infill_prob))

    kept = F.size("tokens") - F.col("__count")
    source, target = A.head(F.col("tokens"), kept), A.drop(F.col("tokens"), kept)
    counted = A.counting(0, F.col("__count") + 1) if block_positions else F.concat(F.array(F.lit(0)), A.repeat(1, F.col("__count")))
    # The lambda keeps Spark from one generated method for all five arrays, which would be too long for the JVM to compile.
    loss = A.let(kept, lambda n: F.concat(A.repeat(0, n + 1), A.drop(F.col("loss_mask").cast("array<int>"), n)))
    suffix = df.filter("suffix").withColumns({
        "text": F.concat(source, F.array(F.lit(special.gmask), F.lit(special.sop)), A.head(target, F.col("__count") - 1)),
        "target": F.concat(source, F.array(F.lit(special.gmask)), target),
        "loss_mask": loss,
        "position": F.concat(A.counting(0, kept + 1), A.repeat(kept.cast("int"), F.col("__count"))),
        "block_position": F.concat(A.repeat(0, kept), counted),
        "sep": (kept + 1).cast("int"),
    })
    infill = df.filter("not suffix").withColumn(
        "spans", spread_spans(key, F.col("tokens"), F.array(F.col("__count")), 1.0, special.eos, special.cls, f"{seed}-place"))
    infill = blank_layout(infill.filter(F.size("spans") == 1), key, special, seed, mask_id=special.gmask, block_positions=block_positions)
    # As constants, so that a caller's filter on `suffix` leaves out the other half's work.
    halves = [half.withColumn("suffix", F.lit(own)).drop("spans") for half, own in ((suffix, True), (infill, False))]
    return halves[0].unionByName(halves[1]).drop("__lo", "__hi", "__count", "tokens")


def short_samples(
    df: DataFrame, key: str, batch: str, special: Special, sentence_ends: Sequence[int], length: int, seed: str | int
) -> DataFrame:
    """Cut samples into shorter ones at sentence or document borders; the wanted size is drawn once per batch."""
    df = df.withColumn("__size", (32 + hash_below(length - 1 - 32, f"{seed}-size", batch)).cast("int"))
    df = df.withColumns({"__t": A.drop(F.col("tokens"), 1), "__l": A.drop(F.col("loss_mask").cast("array<int>"), 1)})
    stops = A.positions_where(F.col("__t"), lambda x: x.isin(list(sentence_ends)) | (x == special.eos))
    df = df.withColumn("__stops", stops)
    # A piece may start behind a stop, unless an eos stands there, and at 0.
    starts = F.filter(F.transform("__stops", lambda p: p + 1), lambda s: F.coalesce(F.get("__t", s) != special.eos, F.lit(False)))
    df = df.withColumn("__starts", F.concat(F.array(F.lit(0)), starts))

    def piece(k: Column) -> Column:
        size = F.col("__size")
        drawn = hash_below(F.greatest(F.size("__t") - size, F.lit(1)), f"{seed}-start", key, k)
        start = A.let(drawn, lambda d: F.array_max(F.filter("__starts", lambda s: s <= d)))

        def cut(s: Column) -> Column:
            end = A.let(s, lambda b: F.coalesce(F.array_max(F.filter("__stops", lambda p: (p + 1 <= b + size) & (p + 1 > b))) + 1, b))
            end = A.let(end, lambda e: F.when(e - s < F.floor(size / 2), s + size).otherwise(e))
            whole = size >= F.size("__t")
            return A.let(end, lambda e: F.struct(
                k.cast("int").alias("piece"),
                F.concat(F.array(F.lit(special.cls)), F.when(whole, F.col("__t")).otherwise(A.take(F.col("__t"), s, e - s))).alias("tokens"),
                F.concat(F.array(F.lit(0)), F.when(whole, F.col("__l")).otherwise(A.take(F.col("__l"), s, e - s))).alias("loss_mask"),
            ))

        return A.let(start.cast("int"), cut)

    pieces = F.transform(A.counting(0, F.floor(F.lit(length - 1) / F.col("__size")).cast("int")), piece)
    return df.select(key, batch, F.explode(pieces).alias("p")).select(key, batch, "p.*")


# --- classic masked pairs, word blanks, multi-blank sources ----------------------------------------------------------


def masked_pair(
    df: DataFrame, key: str, special: Special, vocab_size: int, length: int, seed: str | int, share: float = 0.15, max_predictions: int = 80
) -> DataFrame:
    """cls a sep b sep with some tokens predicted: 80 % become the mask, 10 % stay, 10 % turn into a random text token."""
    a, b = F.col("tokens_a"), F.col("tokens_b")
    one = lambda x: F.array(F.lit(x))
    df = df.withColumns({
        "__t": F.concat(one(special.cls), a, one(special.sep), b, one(special.sep)),
        "types": F.concat(A.repeat(0, F.size(a) + 2), A.repeat(1, F.size(b) + 1)),
        "__open": F.concat(one(False), A.repeat(True, F.size(a)), one(False), A.repeat(True, F.size(b)), one(False)),
    })
    wanted = F.least(F.lit(max_predictions), F.greatest(F.lit(1), F.bround(F.size("__t") * share).cast("int")))
    # Tokens that must stay get a number behind all others.
    numbers = A.let(_numbers(F.size("__open"), seed, key), lambda ns: F.transform("__open", lambda o, i: F.when(o, F.get(ns, i)).otherwise(F.lit(1 << 62))))
    candidates = F.size(F.filter("__open", lambda o: o))
    df = df.withColumn("__pick", _smallest(numbers, F.least(wanted, candidates)))

    def replaced(x: Column, i: Column) -> Column:
        kind = hash_uniform(f"{seed}-kind", key, i)
        new = A.let(kind, lambda u: F.when(u < 0.8, F.lit(special.mask)).when(u < 0.9, x).otherwise(hash_below(vocab_size, f"{seed}-word", key, i).cast("int")))
        return F.when(F.get("__pick", i), new).otherwise(x)

    return df.withColumns({
        "text": A.pad(F.transform("__t", replaced), length, special.pad),
        "mask": A.pad(F.transform("__pick", lambda p: p.cast("int")), length, 0),
        "mask_labels": A.pad(F.transform("__t", lambda x, i: F.when(F.get("__pick", i), x).otherwise(-1)), length, -1),
        "pad_mask": F.concat(A.repeat(0, F.size("__t")), A.repeat(1, F.lit(length) - F.size("__t"))),
        "types": A.pad(F.col("types"), length, special.pad),
    }).drop("__t", "__open", "__pick", "tokens_a", "tokens_b")


def word_blanks(df: DataFrame, key: str, words: Column, ratio: float, seed: str | int) -> DataFrame:
    """Blank int(n * ratio) random words of a text; words in a row share one [MASK], and their texts become the targets."""
    df = df.withColumn("__w", words)
    hashes = F.transform("__w", lambda w, i: hash_hex(seed, key, i))
    df = df.withColumn("__m", _smallest(hashes, F.floor(F.size("__w") * F.lit(float(ratio))).cast("int")))
    before = lambda i: F.when(i == 0, F.lit(False)).otherwise(F.get("__m", i - 1))
    source = F.filter(F.transform("__w", lambda w, i: F.when(~F.get("__m", i), w).when(~before(i), "[MASK]")), lambda w: w.isNotNull())
    opens = F.filter(F.transform("__m", lambda m, i: F.when(m & ~before(i), i)), lambda i: i.isNotNull())
    closes = F.filter(F.transform("__m", lambda m, i: F.when(m & ~F.coalesce(F.get("__m", i + 1), F.lit(False)), i)), lambda i: i.isNotNull())
    runs = F.struct(opens.alias("opens"), closes.alias("closes"))
    targets = A.let(runs, lambda r: F.transform(r["opens"], lambda o, k: F.concat(
        F.lit(" "), F.array_join(A.take(F.col("__w"), o, F.get(r["closes"], k) - o + 1), " "))))
    return df.withColumns({
        "source": F.when(F.size("__w") > 0, F.concat(F.lit(" "), F.array_join(source, " "))).otherwise(""),
        "targets": targets,
    }).drop("__w", "__m")


def multi_blank_layout(df: DataFrame, special: Special, source_length: int, total_length: int) -> DataFrame:
    """Training layout of a source with several masks: piece k follows as `sop` and its tokens, at the k-th mask's position.

    `df` has `tokens` (with masks) and `pieces` (token arrays, at least one per mask).
    """
    df = df.withColumn("__s", A.fit(F.col("tokens"), source_length, special.pad))
    df = df.withColumn("__at", A.positions_where(F.col("__s"), lambda x: x == special.mask))
    piece = lambda k: F.coalesce(F.get("pieces", k), _none())
    one = lambda x: F.array(F.lit(x))
    size = lambda k: F.size(piece(k)) + 1
    each = lambda body: F.flatten(F.transform("__at", body))
    head = lambda x: A.repeat(x, F.lit(source_length))
    return df.withColumns({
        "text": A.fit(F.concat("__s", each(lambda at, k: F.concat(one(special.sop), piece(k)))), total_length, special.pad),
        "target": A.fit(F.concat(head(0), each(lambda at, k: F.concat(piece(k), one(special.eop)))), total_length, special.pad),
        "loss_mask": A.fit(F.concat(head(0), each(lambda at, k: A.repeat(1, size(k)))), total_length, 0),
        "position": A.fit(F.concat(A.counting(0, F.lit(source_length)), each(lambda at, k: A.repeat(at.cast("int"), size(k)))), total_length, 0),
        "block_position": A.fit(F.concat(head(0), each(lambda at, k: A.counting(1, size(k)))), total_length, 0),
        "sep": F.lit(source_length),
    }).drop("__s", "__at", "tokens", "pieces")


def _split_at(tokens: Column, mark: int) -> Column:
    """Pieces of an array between the occurrences of a token."""
    return A.let(tokens, lambda v: A.let(
        F.concat(F.array(F.lit(-1)), A.positions_where(v, lambda x: x == mark)),
        lambda cuts: F.transform(cuts, lambda c, k: A.take(v, c + 1, F.coalesce(F.get(cuts, k + 1), F.size(v)) - c - 1))))


def fill_blanks(source: Column, generated: Column, special: Special) -> Column:
    """Put generated pieces back in place of the masks; masks without a piece vanish, pad and eop are dropped."""
    pieces = _split_at(F.filter(generated, lambda x: (x != special.eop) & (x != special.pad)), special.sop)
    parts = _split_at(F.filter(source, lambda x: x != special.pad), special.mask)
    return A.let(F.struct(pieces.alias("p"), parts.alias("s")), lambda v: F.flatten(F.transform(
        v["s"], lambda part, k: F.concat(F.when(k == 0, _none()).otherwise(F.coalesce(F.get(v["p"], k - 1), _none())), part))))
