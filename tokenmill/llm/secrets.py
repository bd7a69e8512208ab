"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must hold. The documents of a block
are indexed by the trigrams that the rules ask for, the postings of a query are intersected and united, and only the candidates
are verified with the expression itself. A rule without mandatory trigrams scans every document. Blocks are the pieces of Arrow
batches, as search engines keep segments: postings never leave their block, so nothing is shuffled, no group grows with the
data and a lost task is simply run again.

Defined results: a null text is empty and has no spans; texts are scanned whole; places are code points, ends exclusive; a repeated
row gives a repeated result; an input column called `spans` is replaced, other columns are kept where asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.common import pieces, released, utf8

ALL = ("all",)  # the query that any document meets
MOST_STRINGS = 64  # alternatives of a literal part, beyond which it is taken as open


@dataclass(frozen=True)
class Rule:
    """A match counts if its `group` has at least `least` characters; one that has not is passed over whole."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([either_case(w) for w in ("password", "passwd", "secret", "token")] + [either_case("api") + "_?" + either_case("key")])
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of [0-9a-f]+ that have 24 characters or more
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def both(parts: list) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def either(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def literal_query(strings: set[str]) -> tuple:
    """Documents with one of the strings hold all trigrams of one of them."""
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), s).encode() for s in sorted(strings)]
    return either([both([("has", b[i:i + 3]) for i in range(len(b) - 2)]) if len(b) >= 3 else ALL for b in folded])


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """The strings that a sequence of parsed nodes can match, if they are few, and its query."""
    known, queries, closed = {""}, [], True

    def flush() -> None:
        nonlocal known
        queries.append(literal_query(known))
        known = {""}

    for op, value in nodes:
        strings, query = _node(op, value)
        if strings is not None and len(known) * len(strings) <= MOST_STRINGS:
            known = {a + b for a in known for b in strings}
            continue
        flush()
        closed = False
        if strings is not None:
            known = strings
        else:
            queries.append(query)
    if closed:
        return known, literal_query(known)
    flush()
    return None, both(queries)


def _node(op, value) -> tuple[set[str] | None, tuple]:
    name = str(op)
    if name == "LITERAL":
        return {chr(value)}, ALL
    if name == "IN":
        found: set[str] = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                found.add(chr(v))
            elif str(kind) == "RANGE" and v[1] - v[0] < MOST_STRINGS:
                found |= {chr(c) for c in range(v[0], v[1] + 1)}
            else:
                return None, ALL
        return (found, ALL) if len(found) <= 8 else (None, ALL)
    if name == "SUBPATTERN":
        return _walk(value[3])
    if name == "BRANCH":
        parts = [_walk(branch) for branch in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), ALL
        return None, either([q for _, q in parts])
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        strings, query = _walk(inner)
        if strings is not None and least == 0 and most == 1:
            return strings | {""}, ALL
        if strings is not None and least == most and len(strings) ** least <= MOST_STRINGS:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in strings}
            return out, ALL
        return None, query if least else ALL
    return None, ALL


def trigram_query(pattern: str) -> tuple:
    """('all',), ('has', trigram), ('and', ...) or ('or', ...): what every text with a match holds, ASCII letters in lower case."""
    return _walk(_parser.parse(pattern))[1]


def trigrams_of(query: tuple) -> set[bytes]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(trigrams_of(q) for q in query[1:])) if query != ALL else set()


def answer(query: tuple, postings: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    """The rows of a block that meet the query, as flags."""
    if query == ALL:
        return np.ones(rows, bool)
    if query[0] == "has":
        return postings[query[1]]
    parts = [answer(q, postings, rows) for q in query[1:]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Index:
    """Postings of the wanted trigrams over one block of texts."""

    FOLD = np.arange(256, dtype=np.uint8)
    FOLD[65:91] += 32

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        self.number = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def block(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        rows = len(offsets) - 1
        postings = np.zeros((len(self.wanted) + 1, rows), bool)
        if len(data) >= 3:
            b = self.FOLD[data].astype(np.uint32)
            found = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + 3 <= offsets[row + 1]
            postings[found[at[inside]], row[inside]] = True
        return dict(zip(self.wanted, postings[1:]))


def find(rule: Rule, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, of which those with a short group are dropped."""
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, redact: bool = False) -> DataFrame:
    """Columns `keep` (all by default) and `spans`, ordered by start and then by the order of the rules.

    With `redact`, every span of the text is replaced by its kind in brackets; spans that overlap make one.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != "spans"]
    fields = [df.schema[c] for c in keep]
    asked = list(dict.fromkeys([*keep, text_col]))
    queries = [trigram_query(r.pattern) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sorted(set().union(*(trigrams_of(q) for q in queries))))
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            column = batch.column(text_col)
            data, offsets = utf8(column)
            spans, texts = [], []
            for first, last in pieces(offsets):
                at = offsets[first:last + 1] - offsets[first]
                postings = index.block(data[offsets[first]:offsets[last]], at)
                flags = [answer(q, postings, last - first) for q in queries]
                for k, text in enumerate(column.slice(first, last - first).to_pylist()):
                    found = [(s, n, e) for n, r in enumerate(rules) if flags[n][k] for s, e in find(r, compiled[n], text or "")]
                    found.sort()
                    spans.append([{"kind": rules[n].kind, "start": s, "end": e} for s, n, e in found])
                    if redact:
                        texts.append(text if not found else masked(text, [(s, e, rules[n].kind) for s, n, e in found]))
            out = [pa.array(texts, pa.string()) if redact and c == text_col else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(spans, _ARROW)], [*keep, "spans"])

    return df.select(*asked).mapInArrow(released(run), T.StructType([*fields, T.StructField("spans", SPANS)]))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            out += [text[end:start], f"[{kind}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def op1(spark, sf_dir: str) -> DataFrame:
    df = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return df.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule, order: int) -> str:
    """Matches in order, and the texts between them, give the places."""
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT r, {order} AS k, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
        's': coalesce(list_sum(list_transform(b[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0),
        'n': length(m[i]), 'g': length(regexp_extract(m[i], '{pattern}', {rule.group}))}})) AS x
      FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS b FROM t) WHERE len(m) > 0"""


_LEAST = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
OP1_SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
s AS (SELECT r, k, kind, CAST(x.s AS BIGINT) AS a, concat(kind, ':', CAST(x.s AS BIGINT), ':', CAST(x.s + x.n AS BIGINT)) AS z FROM m WHERE x.g >= CASE k {_LEAST} END),
g AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(z, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(z, ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""
