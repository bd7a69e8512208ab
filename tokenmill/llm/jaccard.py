"""N-gram Jaccard join by signature trees.

Two documents link when their sets of distinct word shingles have a Jaccard similarity of at least `share`. The join is exact up
to equality of 64-bit hashes of shingles.

Routing. Linked sets share a shingle among the first n - ceil(share * n) + 1 of each in any common order. Shingles go by their
hash, those that many documents hold last (blocks report what several of their documents hold; the order decides the work only,
never the result). The sets that hold one of these shingles are a list; equal lists count once. In a list of up to 64 sets, pairs
whose hashed bitmaps leave room for the overlap that they need are joined; longer lists, which come from large groups of near copies,
are joined whole. Only sets of one component of these edges can link.
Trees. Components are dealt into bins of bounded size, and one that is larger into chunks whose pairs are bins. A bin numbers the
shingles that two of its sets hold and gives each set a bitmap over them. A tree stands on the sets, neighbours of one component
side by side: a node holds the OR of its bitmaps and the range of its sizes. Pairs of nodes are traversed from the root; the
largest possible overlap of a pair is the number of common bits, or the largest size, and where that cannot reach the share of the
smallest possible union the pair and all below it are left out. Pairs of leaves are counted exactly.

Equal sets, told apart by a 64-bit hash of their size and hashes, are one class with a weight. A bin gives back one row per set - its weighted number of links and the least set that it
reaches - so pairs never leave their task, and classes are joined to components by another round over those rows.

Defined results: null, empty and blank texts have an empty set, link with nothing and make a component of their own; texts with
fewer words than a shingle have one shingle, all their words; repeated rows are links of each other; columns other than id and
text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import Words, list_array, mixed, pieces, released, stored, utf8
from tokenmill.llm.components import components

WIDTH = 5
SHARE = (3, 4)  # of the union
COMMON_TOKENS = 1 << 18  # most frequent shingles that go last
BLOCK_ROWS, BLOCK_TOKENS = 10_000, 1 << 22  # documents, at most, whose common shingles are reported and whose equal sets count once, in batches of any size
COMMON_IN_BLOCK = 4  # documents of a block that hold a shingle it reports
FILTER_BITS = 26  # log2 of the bits of the filter before sets are shuffled
SHORT_LIST = 64  # sets; longer lists skip the test of their hashed bitmaps
BIN_TOKENS, BIN_SETS = 300_000, 1_500
FANOUT = 8
NOT_SPACE = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
STEP_BYTES = 8 << 20  # of bitmaps that are compared at once
STEP_PAIRS = 1 << 18  # of nodes that are looked at, or made from pairs above them, at once
SPARSE_UP_TO = 256  # shingles; bitmaps of larger sets have at least one bit for each, not two


class Shingles:
    """Sets of 64-bit shingle hashes of the texts of a column."""

    def __init__(self, width: int):
        self.width, self.split = width, Words(NOT_SPACE)
        self.odd = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        data, offsets = utf8(column)
        for first, last in pieces(offsets):
            words, counts = self.split(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            n = max(0, len(words) - self.width + 1)
            hashes = np.zeros(n, np.uint64)
            for k in range(self.width):
                hashes = mixed(hashes + words[k:k + n] * self.odd[k])
            start = 0
            for count in counts.tolist():
                if count >= self.width:
                    own = np.sort(hashes[start:start + count - self.width + 1])
                    yield own[np.concatenate([[True], own[1:] != own[:-1]])]
                elif count:
                    h = np.full(1, count, np.uint64)
                    for k in range(count):
                        h = mixed(h + words[start + k:start + k + 1] * self.odd[k])
                    yield h
                else:
                    yield np.zeros(0, np.uint64)
                start += count


def class_of(tokens: np.ndarray) -> int:
    """One number for equal sets."""
    with np.errstate(over="ignore"):
        h = mixed(np.array([len(tokens)], np.uint64) + np.add.reduce(mixed(tokens), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = mixed(h ^ np.bitwise_xor.reduce(tokens))
    return int(h.view(np.int64)[0])


def held_often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sets hold, and in how many; counted by parts of the hashes' range."""
    edges = np.arange(1, 8, dtype=np.uint64) << np.uint64(61)
    cuts = [[0, *np.searchsorted(s, edges).tolist(), len(s)] for s in sets]
    out = []
    for k in range(len(edges) + 1):
        tokens, counts = np.unique(np.concatenate([*(s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)), np.zeros(0, np.uint64)]), return_counts=True)
        some = counts >= COMMON_IN_BLOCK
        out.append((tokens[some], counts[some]))
    return np.concatenate([t for t, _ in out]), np.concatenate([c for _, c in out])


def prefix_length(n: int, share: tuple[int, int]) -> int:
    return n + share[0] * -n // share[1] + 1


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """Per document: id, hash of the id, size and class of its set; one row of each block also has the shingles common in it."""

    def out(columns: list[pa.Array], block: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = held_often(block)
        at_first = np.zeros(len(columns[0]), np.int64)
        at_first[:1] = len(tokens)
        return pa.RecordBatch.from_arrays([*columns, list_array(tokens.view(np.int64), at_first, pa.int64()), list_array(counts, at_first, pa.int64())], ["id", "h", "n", "k", "common", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, block, last = Shingles(width), [], None  # last: the batch that has the block's report if no other follows
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                yield out(last, [])
            sets = list(make(batch.column("t")))
            block += sets
            last = [batch.column("id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())]
            if len(block) >= BLOCK_ROWS or sum(map(len, block)) >= BLOCK_TOKENS:
                yield out(last, block)
                block, last = [], None
        if last is not None:
            yield out(last, block)

    return docs.mapInArrow(released(run), f"id {docs.schema['id'].dataType.simpleString()}, h long, n long, k long, common array<long>, held array<long>")


def _prefixes(docs: DataFrame, common: np.ndarray, rank: np.ndarray, width: int, share: tuple[int, int]) -> DataFrame:
    """(token, k): the shingles by which a set can meet its partners; equal sets of a block give them once."""
    sent = docs.sparkSession.sparkContext.broadcast((common, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, (common, rank), seen, rows = Shingles(width), sent.value, set(), 0
        for batch in batches:
            if rows >= BLOCK_ROWS:
                seen, rows = set(), 0
            rows += batch.num_rows
            tokens, keys, counts = [], [], []
            for own in make(batch.column("t")):
                key = class_of(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                need = prefix_length(len(own), share)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    last = common[at] == own
                    first = own[~last]
                    if len(first) < need:
                        first = np.concatenate([first, own[last][np.argsort(rank[at[last]], kind="stable")]])
                    own = first
                tokens.append(own[:need])
                keys.append(key)
                counts.append(need)
            flat = np.concatenate([*tokens, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(keys, np.int64), counts))], ["token", "k"])

    return docs.select("t").mapInArrow(released(run), "token long, k long")


def _payload(docs: DataFrame, classes: DataFrame, width: int, make_column: Callable[[pa.Array, list[np.ndarray]], pa.Array]) -> DataFrame:
    """The classes' columns and a binary `payload` made of texts and their sets, read again from one document of each class.

    A bitmap of fixed size over class and document keeps most other documents out of the shuffle; the join decides.
    """
    bit = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.col("k")), 64 - FILTER_BITS) + 1
    bits = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for row in classes.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map")).collect():
        own = np.frombuffer(bytes(row["map"]), np.uint8)
        bits[(row["at"] - 1) * len(own):row["at"] * len(own)] = own  # Spark counts buckets and the values in them from 1
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, wanted = Shingles(width), sent.value
        for batch in batches:
            ids = np.asarray(batch.column("h"))
            keys, rows, sets = [], [], []
            for row, own in enumerate(make(batch.column("t"))):
                key = class_of(own)
                at = int((np.int64(key) ^ ids[row]).view(np.uint64) >> shift)
                if wanted[at >> 3] >> (at & 7) & 1:
                    keys.append(key)
                    rows.append(row)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids[rows], pa.int64()), make_column(batch.column("t").take(pa.array(rows, pa.int64())), sets)], ["k", "h", "payload"])

    return docs.select("h", "t").mapInArrow(released(run), "k long, h long, payload binary").join(classes, ["k", "h"])


def text_column(texts: pa.Array, sets: list[np.ndarray]) -> pa.Array:
    """Texts pressed one by one: a set of 64-bit hashes is about as long as its text, and takes hardly any pressing."""
    return pa.array([zlib.compress(t, 1) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def sets_of(column: pa.ChunkedArray, rows: np.ndarray, width: int) -> list[np.ndarray]:
    """The sets of pressed texts, in the order of `rows`."""
    texts = map(zlib.decompress, column.take(pa.array(rows, pa.int64())).to_pylist())
    return list(Shingles(width)(pa.array(texts, pa.large_binary()).view(pa.large_string())))


def bitmap_width(n: int) -> int:
    """Bits: a power of two, never less for more shingles. Unrelated large sets stay apart with half the bits, as chance evens out in them."""
    return max(64, 1 << (2 * min(n, SPARSE_UP_TO) - 1).bit_length(), 1 << (n - 1).bit_length())


def bitmap_column(sets: list[np.ndarray]) -> pa.Array:
    """Hashed bitmaps of at least one bit for each shingle; the low bits of a hash choose."""
    out = []
    for own in sets:
        bits = np.zeros(bitmap_width(len(own)), bool)
        bits[own & np.uint64(len(bits) - 1)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def may_link(a: tuple[int, int], b: tuple[int, int], share: tuple[int, int]) -> bool:
    """Of two sets as (size, bitmap): whether the bitmaps leave room for the overlap. A set has size - bits shingles beyond its bits."""
    (n, x), (m, y) = sorted([a, b])
    if share[1] * n < share[0] * m:
        return False
    for width in range(bitmap_width(m).bit_length() - 2, bitmap_width(n).bit_length() - 2, -1):
        y = (y >> (1 << width)) | (y & ((1 << (1 << width)) - 1))
    most = min(n, (x & y).bit_count() + min(n - x.bit_count(), m - y.bit_count()))
    return (share[0] + share[1]) * most >= share[0] * (n + m)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token and class: (list, a, 0) for each set of a short list, (0, a, b) from a long list's first set to its others."""
    tokens, keys, long = np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def rows(tokens, keys):
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        sizes = np.diff(starts, append=len(tokens))
        names = mixed(np.add.reduceat(mixed(keys.view(np.uint64)), starts)).view(np.int64) | 1 if len(starts) else starts
        size, name, first = (np.repeat(x, sizes) for x in (sizes, names, keys[starts]))
        short, over = (size > 1) & (size <= SHORT_LIST), (size > SHORT_LIST) & (first != keys)
        zeros = np.zeros(len(keys), np.int64)
        return [np.concatenate([x[short], y[over]]) for x, y in ((name, zeros), (keys, first), (zeros, keys))]

    def out(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "a", "b"])

    for batch in batches:
        tokens, keys = (np.concatenate([x, np.asarray(batch.column(k))]) for k, x in enumerate((tokens, keys)))
        if not len(tokens):
            continue
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])])
        tokens, keys = tokens[new], keys[new]
        if long:  # the first row stands for a long list that began in an earlier batch
            n = int(np.searchsorted(tokens != tokens[0], True))
            yield out([np.zeros(n - 1, np.int64), np.full(n - 1, keys[0]), keys[1:n]])
            if n == len(tokens):
                tokens, keys = tokens[:1], keys[:1]
                continue
            tokens, keys, long = tokens[n:], keys[n:], False
        last = int(np.flatnonzero(tokens == tokens[-1])[0])
        yield out(rows(tokens[:last], keys[:last]))
        tokens, keys = tokens[last:], keys[last:]
        if len(tokens) > SHORT_LIST:
            yield out(rows(tokens, keys))
            tokens, keys, long = tokens[:1], keys[:1], True
    if not long:
        yield out(rows(tokens, keys))


def _possible(share: tuple[int, int]):
    """Of rows (list, k, n, payload) that lie together by list: edges that join the sets which may link, a tree for each component."""

    def edges(members: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int]]:
        left = list(members)
        while left:
            reached = [left.pop(0)]
            for k in reached:
                for other in [o for o in left if may_link(members[k], members[o], share)]:
                    left.remove(other)
                    reached.append(other)
                    yield k, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, members, found = None, {}, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("list", "k", "n", "payload"))):
                if row[0] != name:
                    found += edges(members)
                    name, members = row[0], {}
                members[row[1]] = (row[2], int.from_bytes(row[3], "little"))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found = []
        found += edges(members)
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


class Tree:
    """Levels from the leaves up: OR of bitmaps, least and largest size."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.levels = [(bitmaps, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def links(self, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves a < b with enough overlap, by a traversal of the tree against itself."""
        up, down = share
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            maps, low, high = self.levels[level]
            step = max(1, min(STEP_BYTES // max(1, maps.shape[1] * 8), STEP_PAIRS // FANOUT**2 if level else STEP_PAIRS))
            if len(a) > step:
                stack += [(level, a[i:i + step], b[i:i + step]) for i in range(0, len(a), step)]
                continue
            if level == 0:
                a, b = a[a < b], b[a < b]
            # the least sizes bound the union from below, the common bits and the largest sizes the overlap from above
            fits = (down * high[a] >= up * low[b]) & (down * high[b] >= up * low[a])
            a, b = a[fits], b[fits]
            most = np.minimum(np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64), np.minimum(high[a], high[b]))
            meets = (up + down) * most >= up * (low[a] + low[b])
            a, b = a[meets], b[meets]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below = len(self.levels[level - 1][0])
            child = np.arange(FANOUT)
            a, b = (np.broadcast_to(x, (len(a), FANOUT, FANOUT)).ravel() for x in (a[:, None, None] * FANOUT + child[:, None], b[:, None, None] * FANOUT + child))
            inside = (a < below) & (b < below) & (a <= b)
            stack.append((level - 1, a[inside], b[inside]))


def join_bin(keys: np.ndarray, chunks: np.ndarray, weights: np.ndarray, tokens: list[np.ndarray], across: bool, share: tuple[int, int]) -> pd.DataFrame:
    """Links inside a bin, or only those across its two chunks: (k, links, reached) of the sets that have some."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    _, number, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[number] > 1
    place = (np.cumsum(held > 1) - 1)[number[shared]]
    words = max(1, -(-int((held > 1).sum()) // 64))
    bitmaps = np.zeros((len(tokens), words), np.uint64)
    np.bitwise_or.at(bitmaps, (owner[shared], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    links, reached = np.zeros(len(tokens), np.int64), np.arange(len(tokens))
    for a, b in Tree(bitmaps, sizes).links(share):
        if across:
            other = chunks[a] != chunks[b]
            a, b = a[other], b[other]
        links += np.bincount(a, weights[b], len(tokens)).astype(np.int64) + np.bincount(b, weights[a], len(tokens)).astype(np.int64)
        while (reached[a] != reached[b]).any():  # `reached` holds roots, and only roots are hooked: no link of an earlier slice is lost
            np.minimum.at(reached, np.maximum(reached[a], reached[b]), np.minimum(reached[a], reached[b]))
            while (reached != reached[reached]).any():
                reached = reached[reached]
    some = links > 0
    return pd.DataFrame({"k": keys[some], "links": links[some], "reached": keys[reached[some]]})


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))


def classes_of(narrow: DataFrame) -> DataFrame:
    """Per set of documents (id, h, n, k): its size and weight, the least id and a document to read it from."""
    return narrow.where("n > 0").groupBy("k").agg(F.min("h").alias("h"), F.min("id").alias("least"), F.count("*").alias("weight"), F.first("n").alias("n"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """Per input row: id, n_shingles, n_links (documents that it links with) and component_id (the least id reachable)."""
    docs = rows_of(docs, id_col, text_col)
    narrow = stored(_classes(docs, width), "jaccard-classes")
    held = narrow.select(F.explode(F.arrays_zip("common", "held")).alias("c")).groupBy(F.col("c.common").alias("token")).agg(F.sum("c.held").alias("held"))
    held = held.orderBy(F.desc("held"), "token").limit(COMMON_TOKENS).toPandas()
    common = held["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(common)
    narrow = narrow.drop("common", "held")

    met = _prefixes(docs, common[order], held["held"].to_numpy(np.int64)[order], width, share)
    met = met.repartition("token").sortWithinPartitions("token", "k").mapInArrow(released(_lists), "list long, a long, b long")
    met = stored(met.distinct(), "jaccard-lists")
    classes = classes_of(narrow)
    members = met.where("list <> 0").select("list", F.col("a").alias("k"))
    tested = stored(members.select("k").distinct().join(classes.select("k", "h", "n"), "k"), "jaccard-tested")
    bitmaps = _payload(docs, tested, width, lambda _, sets: bitmap_column(sets))
    possible = members.join(bitmaps, "k").select("list", "k", "n", "payload").repartition("list").sortWithinPartitions("list").mapInArrow(released(_possible(share)), "a long, b long")
    parts = components(met.where("list = 0").select("a", "b").unionByName(possible))
    return confirmed(docs, narrow, parts, width, share).withColumnRenamed("id", id_col)


def confirmed(docs: DataFrame, narrow: DataFrame, parts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Links between sets of the same part (node, label), counted on the whole sets: id, n_shingles, n_links, component_id of each document."""
    classes = classes_of(narrow)
    found = parts.withColumnRenamed("node", "k").join(classes.select("k", "h", "weight", "n"), "k")
    found = stored(found, "jaccard-found")
    size = found.groupBy("label").agg(F.greatest(F.ceil(F.sum("n") / BIN_TOKENS), F.ceil(F.count("*") / BIN_SETS)).alias("chunks"))
    found = stored(found.join(stored(size, "jaccard-sizes"), "label"), "jaccard-candidates")  # aggregates by themselves, so that a hot group's join can be split
    total = found.where("chunks = 1").agg(F.sum("n").alias("n"), F.count("*").alias("c")).first()
    bins = max(1, -(-(total["n"] or 0) // BIN_TOKENS), -(-total["c"] // BIN_SETS))
    texts = _payload(docs, found, width, text_column)

    own_bin = F.array(F.struct(F.lit(-1).cast("bigint").alias("root"), F.pmod(F.xxhash64("label"), F.lit(bins)).alias("i"), F.lit(0).cast("bigint").alias("j")))
    chunk = F.pmod(F.xxhash64("k"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda j: F.struct(F.col("label").alias("root"), F.least(chunk, j).alias("i"), F.greatest(chunk, j).alias("j")))
    dealt = texts.select("k", "label", "weight", "payload", chunk.alias("chunk"), (F.col("chunks") > 1).alias("large"), F.explode(F.when(F.col("chunks") == 1, own_bin).otherwise(pairs)).alias("bin"))
    dealt = dealt.select("k", "label", "weight", "payload", "chunk", "large", "bin.root", "bin.i", "bin.j")

    def run(key, table):
        frame = table.select(["k", "label", "chunk", "weight", "large"]).to_pandas()
        rows = frame.drop_duplicates("k").sort_values(["label", "k"]).index.to_numpy()
        frame = frame.loc[rows]
        tokens = sets_of(table.column("payload"), rows, width)
        across = bool(frame["large"].iloc[0]) and key[1].as_py() != key[2].as_py()
        out = join_bin(frame["k"].to_numpy(), frame["chunk"].to_numpy(), frame["weight"].to_numpy(np.float64), tokens, across, share)
        return pa.Table.from_pandas(out, pa.schema([("k", pa.int64()), ("links", pa.int64()), ("reached", pa.int64())]), preserve_index=False)

    linked = dealt.groupBy("root", "i", "j").applyInArrow(run, "k long, links long, reached long")
    linked = stored(linked, "jaccard-links")
    reached = components(linked.select(F.col("k").alias("a"), F.col("reached").alias("b"))).withColumnRenamed("node", "k")
    links = linked.groupBy("k").agg(F.sum("links").alias("links"))
    named = stored(classes.join(reached, "k", "left").join(links, "k", "left").withColumn("label", F.coalesce("label", "k")), "jaccard-reached")
    least = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "jaccard-least")
    named = stored(named.join(least, "label").select("k", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "jaccard-named")
    lone = F.col("n") == 0
    return narrow.join(named, "k", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(lone, F.lit(0)).otherwise(F.col("n_links")).cast("bigint").alias("n_links"),
        F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")
