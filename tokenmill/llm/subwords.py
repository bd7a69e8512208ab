"""SentencePiece encoding and decoding by a Viterbi search that words with a common beginning share.

A text is normalized by the model and cut into marked words: a run of space marks with the characters up to the next mark. No piece
crosses a cut (the vocabulary is checked for that). The distinct words of a block are sorted, which lays their trie out depth first; a stack
holds the forward state of every prefix of the current path, so the next word goes on from the prefix that it shares with the last one.

The forward state of a prefix is the best score of a segmentation and its last piece. For a unigram model every piece may follow
every other. For a merge model the pieces u, t may stand together only if merging their text gives u, t again; a segmentation whose
neighbours all may is the one that merging gives, so the search returns the same ids as the library. Characters without a piece give the ids of
their UTF-8 bytes.

Defined results: null gives null, the empty text an empty list; decoding gives the normalized text back (a literal space mark in a
text is a space afterwards, as the library has it); texts of any length are encoded whole; repeated rows repeat.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import pieces, released, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0
GATHERED = 1 << 19  # words whose ids are put together at once
PAIRS_KEPT = 1 << 18  # answers on neighbouring pieces that a worker remembers


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Top-level fields of a protobuf message: number and value (fixed-width values are passed over)."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value, shift, i = value | (b & 127) << shift, shift + 7, i + 1
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
            yield key >> 3, value
        elif kind == 2:
            size, i = varint(i)
            yield key >> 3, data[i:i + size]
            i += size
        else:
            i += 8 if kind == 1 else 4


class Encoder:
    """A SentencePiece model: 1 = unigram, 2 = merges."""

    def __init__(self, proto: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        trainer = b"".join(v for k, v in _fields(proto) if k == 2 and isinstance(v, bytes))
        self.merges = dict(_fields(trainer)).get(3, 1) == 2
        lib, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {i: lib.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model goes on after a space, so words can't be encoded by themselves")
        self.known = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids  # pieces, and -1 for what only begins one
        self.bytes = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown, self.lost = lib.unk_id(), min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.text = [b"" if lib.is_control(i) else bytes([int(lib.id_to_piece(i)[3:5], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.pairs: dict[int, bool] = {}  # by one number for two pieces, which takes less memory than a tuple

    def merged(self, text: str) -> list[str]:
        """Adjacent parts whose union scores best become one, the first of equals, while there are such."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.score[piece] > best[0]):
                    best = self.score[piece], k
            if best is None:
                return parts
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    def allowed(self, u: int, t: int) -> bool:
        """Whether piece t may follow piece u; u = -1 asks whether t may stand alone."""
        known = self.pairs.get(pair := (u << 32) | t)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            own = [self.pieces[t]] if u < 0 else [self.pieces[u], self.pieces[t]]
            known = self.pairs[pair] = self.merged("".join(own)) == own
        return known

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of sorted distinct words, one after the other, and the number of each; the states of the common prefix with the word before are used again."""
        out, sizes, before = array("i"), array("i"), ""
        states: list[tuple[float, int, int]] = [(0.0, 0, -1)]  # score, start of the last piece, its id (-1: none)
        starts: list[list[int]] = [[]]  # where pieces that may go on began, for each prefix
        known, scores, pairs, free = self.known, self.score, self.pairs, not self.merges
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1:], starts[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best, score, own = None, 0.0, []
                for start in [*starts[end - 1], end - 1]:
                    piece = known.get(word[start:end])
                    if piece is None:
                        continue
                    own.append(start)
                    if piece < 0:
                        continue
                    state = states[start]
                    new = state[0] + scores[piece]
                    if best is None or new > score:
                        if not free:
                            answer = pairs.get((state[2] << 32) | piece)
                            if not (self.allowed(state[2], piece) if answer is None else answer):
                                continue
                        best, score = (new, start, piece), new
                states.append((states[end - 1][0] + self.lost, end - 1, -1) if best is None else best)
                starts.append(own)
            ids, end = [], len(word)
            while end:
                _, start, piece = states[end]
                ids += [piece] if piece >= 0 else [self.bytes.get(b, self.unknown) for b in reversed(word[start:end].encode())] if self.bytes else [self.unknown]
                end = start
            out.extend(reversed(ids))
            sizes.append(len(ids))
            before = word
        return np.array(out, np.int32), np.array(sizes, np.int64)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each."""
        number: dict[str, int] = {}
        words, counts = [], []
        for text in texts:
            own = WORD.findall(self.library.normalize(text)) if text else []
            words.append(np.array([number.setdefault(w, len(number)) for w in own], np.int32))
            counts.append(len(own))
        order = sorted(number)
        flat, coded = self.encode_words(order)
        sizes, starts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        at = np.array([number[w] for w in order], np.int64)
        sizes[at], starts[at] = coded, np.cumsum(coded) - coded
        number.clear()
        word = np.concatenate([*words, np.zeros(0, np.int32)])
        words.clear()
        ids, done = np.zeros(int(sizes[word].sum()), np.int32), 0
        for part in np.array_split(word, len(word) // GATHERED + 1):
            size = sizes[part]
            ends = np.cumsum(size)
            n = int(ends[-1]) if len(ends) else 0
            ids[done:done + n] = flat[np.arange(n) - np.repeat(ends - size - starts[part], size)]
            done += n
        edges = np.concatenate([[0], np.cumsum(sizes[word])])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, np.diff(edges)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


BLOCK_BYTES = 12 << 20  # text whose words share a trie


def _model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, block: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep` (all by default) and `ids` (array of int), and `whole`: whether decoding them gives the normalized text back.

    Smaller blocks (in bytes) take less memory and more time; the ids are the same.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "whole")]
    head = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    sent = df.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            column = batch.column("t")
            for first, last in pieces(utf8(column)[1], block):
                part = batch.slice(first, last - first)
                texts = part.column("t")
                ids, counts = coder.encode(t.as_py() for t in texts)
                ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
                whole = [not t.is_valid or coder.decode(ids[a:b]) == t.as_py().replace(MARK, " ") for t, a, b in zip(texts, ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array([e if t.is_valid else None for t, e in zip(texts, ends)] + [ends[-1]], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(f"k{i}") for i in range(len(keep))], lists, pa.array(whole, pa.bool_())], [*[f"k{i}" for i in range(len(keep))], "ids", "whole"])

    out = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t")).mapInArrow(released(run), f"{head}{', ' if head else ''}ids array<int>, whole boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "whole")


def decode(df: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """Columns `keep` (all by default) and `decoded`, the text of the ids; null ids give null."""
    keep = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    head = ", ".join(f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    sent = df.sparkSession.sparkContext.broadcast(_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            texts = [None if row.as_py() is None else coder.decode(np.asarray(row.values)) for row in batch.column("i")]
            yield pa.RecordBatch.from_arrays([*[batch.column(f"k{i}") for i in range(len(keep))], pa.array(texts, pa.string())], [*[f"k{i}" for i in range(len(keep))], "decoded"])

    out = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids_col).alias("i")).mapInArrow(released(run), f"{head}{', ' if head else ''}decoded string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "decoded")


def op2(spark, sf_dir: str) -> DataFrame:
    df = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    return df.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_ids"), "ids", "whole")
