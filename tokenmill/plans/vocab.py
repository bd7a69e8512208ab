"""Word counts, vocabularies, encoding and decoding over `documents`."""

from pyspark.sql import functions as F

from tokenmill.functions import text as T
from tokenmill.operators import vocab as V
from tokenmill.plans.registry import query
from tokenmill.plans.sqltext import codes, joined, words
from tokenmill.session import cut_lineage

VOCAB_SIZE = 400
TOP_SQL = f"""freq AS (SELECT word, count(*) AS n FROM (SELECT unnest({words("text")}) AS word FROM documents) GROUP BY word),
vocab AS (SELECT word AS token, (row_number() OVER (ORDER BY n DESC, word) - 1)::INTEGER AS id, n FROM freq ORDER BY n DESC, word LIMIT {VOCAB_SIZE})"""


def _vocab(t):
    return V.top_words(V.word_frequencies(t.documents), VOCAB_SIZE)


@query("voc01_word_frequencies", f"WITH {TOP_SQL} SELECT word, n FROM freq")
def _(t):
    return V.word_frequencies(t.documents)


@query("voc01_top_words", f"WITH {TOP_SQL} SELECT token, id, n FROM vocab")
def _(t):
    return _vocab(t)


SENTENCES_SQL = "list_filter(string_split(regexp_replace({}, '([.?!])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')"


@query(
    "voc01_frequency_stats",
    f"""SELECT sum(len({SENTENCES_SQL.format("line")}))::BIGINT AS n_sentences, max(length(line)) AS longest_line
    FROM (SELECT unnest(string_split(trim(text), chr(10))) AS line FROM documents) WHERE line <> ''""",
)
def _(t):
    return V.frequency_stats(t.documents)


BASIC_SQL = """list_filter(flatten(list_transform({}, lambda w: CASE WHEN w IN ('[UNK]', '[SEP]', '[PAD]', '[CLS]', '[MASK]') THEN [w]
  ELSE regexp_extract_all(strip_accents(lower(w)), '[[:punct:]]|[^[:punct:]]+') END)), lambda w: w <> '')"""
MARKED = "replace(text, ' of ', ' [MASK] ')"


@query("voc03_basic_tokens", f"SELECT doc_id, {joined(BASIC_SQL.format(words(MARKED)))} AS tokens FROM documents")
def _(t):
    marked = F.replace(F.col("text"), F.lit(" of "), F.lit(" [MASK] "))
    return t.documents.select("doc_id", F.array_join(V.basic_tokens(marked), " ").alias("tokens"))


# Pieces: frequent words, and every one- to three-letter part of them as a continuation; ids by text order.
PIECES_SQL = f"""{TOP_SQL}, basic AS (SELECT doc_id, {BASIC_SQL.format(words("text"))} AS ws FROM documents),
top AS (SELECT w AS token, count(*) AS n FROM (SELECT unnest(ws) AS w FROM basic) GROUP BY w ORDER BY n DESC, w LIMIT 60),
parts AS (SELECT DISTINCT '##' || substr(token, s, l) AS token FROM top, range(1, 40) a(s), range(1, 4) b(l) WHERE s + l - 1 <= length(token)
  UNION SELECT DISTINCT substr(token, s, l) FROM top, range(1, 40) a(s), range(1, 3) b(l) WHERE s + l - 1 <= length(token) UNION SELECT token FROM top),
pieces AS (SELECT token, (row_number() OVER (ORDER BY token))::INTEGER AS id FROM parts)"""


def _pieces(counts):
    top = V.top_words(counts, 60).select("token")
    spots = top.select("token", F.explode(F.sequence(F.lit(1), F.length("token"))).alias("s"))
    spans = spots.select("token", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.length("token") - F.col("s") + 1))).alias("l"))
    part = F.expr("substring(token, s, l)")
    parts = spans.select(F.concat(F.lit("##"), part).alias("token")).union(spans.filter("l < 3").select(part)).union(top).distinct()
    ids = F.array_sort(F.collect_set("token"))
    return F.broadcast(parts.agg(ids.alias("ts")).select(F.posexplode("ts").alias("id", "token")).select((F.col("id") + 1).alias("id"), "token"))


@query(
    "voc04_wordpiece_encode",
    f"""WITH RECURSIVE {PIECES_SQL}, words AS (SELECT DISTINCT unnest(ws) AS word FROM basic),
    walk AS (SELECT word, 1::BIGINT AS nxt, []::INTEGER[] AS ids FROM words
      UNION ALL SELECT word, nxt + step.l, list_append(ids, step.id) FROM (
        SELECT w.word, w.nxt, w.ids, max(struct_pack(l := length(replace(p.token, '##', '')), id := p.id)) AS step
        FROM walk w JOIN pieces p ON p.token = CASE WHEN w.nxt > 1 THEN '##' ELSE '' END || substr(w.word, w.nxt, length(replace(p.token, '##', '')))
        WHERE w.nxt <= length(w.word) GROUP BY w.word, w.nxt, w.ids)),
    dictionary AS (SELECT word, coalesce(max(ids) FILTER (WHERE nxt = length(word) + 1), [0]) AS ids FROM walk GROUP BY word),
    placed AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM basic)
    SELECT doc_id, string_agg({joined("ids")}, ' ' ORDER BY i) AS tokens FROM placed JOIN dictionary USING (word) GROUP BY doc_id""",
)
def _(t):
    # The words are read three times, so they are written once; so are their counts.
    basic = cut_lineage(t.documents.select("doc_id", V.basic_tokens(F.col("text")).alias("ws")))
    counts = cut_lineage(V.distinct_words(basic, F.col("ws")))
    dictionary = V.wordpiece_dictionary(counts, _pieces(counts), unk=0)
    return V.expand_words(basic, ["doc_id"], F.col("ws"), dictionary, counts=counts).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


MERGES, ENCODED_MERGES = 24, 12


def _learned_sql(source: str, merges: int) -> str:
    """Merges learned step by step from `source` (word, n, s), in which every symbol of s has a space on both sides: m0, m1, ... and w1, w2, ..."""
    steps = [f"w0 AS MATERIALIZED ({source})"]
    for k in range(merges):
        steps.append(f"""m{k} AS MATERIALIZED (SELECT l, r FROM (SELECT ss[i] AS l, ss[i + 1] AS r, sum(n) AS c FROM (SELECT n, string_split(trim(s), '  ') AS ss FROM w{k}), unnest(range(1, len(ss))) AS u(i) GROUP BY 1, 2)
      ORDER BY c DESC, l, r LIMIT 1)""")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT word, n, coalesce((SELECT replace(s, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') FROM m{k}), s) AS s FROM w{k})")
    return ", ".join(steps)


SPACED = "list_reduce(list_prepend('', list_transform(list_filter(string_split({}, ''), lambda c: c <> ''), lambda c: ' ' || c || ' ')), lambda a, c: a || c)"
RANKED = " UNION ALL ".join(f'SELECT {k}::INTEGER AS rank, l AS "left", r AS "right" FROM m{k}' for k in range(MERGES))


@query("voc02_learned_merges", f"WITH {TOP_SQL}, {_learned_sql(f'SELECT word, n, {SPACED.format('word')} AS s FROM freq', MERGES)} {RANKED}")
def _(t):
    merges = V.learn_merges(V.word_frequencies(t.documents), MERGES)
    return t.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "rank int, left string, right string")


@query(
    "voc05_byte_pair_encode",
    f"WITH {TOP_SQL}, {_learned_sql(f'SELECT word, n, {SPACED.format('word')} AS s FROM freq', ENCODED_MERGES)} SELECT word, replace(trim(s), '  ', ' ') AS pieces FROM w{ENCODED_MERGES}",
)
def _(t):
    frequencies = cut_lineage(V.word_frequencies(t.documents))
    dictionary = V.byte_pair_dictionary(frequencies, V.learn_merges(frequencies, ENCODED_MERGES), byte_level=False)
    return dictionary.select("word", F.array_join("pieces", " ").alias("pieces"))


BYTE_WORDS_SQL = r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS word FROM documents) GROUP BY word"""
# Bytes 33-126, 161-172 and 174-255 stand for themselves, the others follow from 256 in their order.
BYTE_LETTERS_SQL = """list_transform(range(octet_length(encode(word))), lambda i: CASE WHEN b[i + 1] BETWEEN 33 AND 126 OR b[i + 1] BETWEEN 161 AND 172 OR b[i + 1] >= 174 THEN chr(b[i + 1])
      ELSE chr(256 + CASE WHEN b[i + 1] <= 32 THEN b[i + 1] WHEN b[i + 1] <= 160 THEN b[i + 1] - 94 ELSE 67 END) END)"""


@query(
    "voc05_byte_level_encode",
    f"""WITH counted AS ({BYTE_WORDS_SQL}), bytes AS (SELECT word, n, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::INTEGER) AS b FROM counted),
    spelled AS (SELECT word, n, array_to_string({BYTE_LETTERS_SQL}, '') AS letters FROM bytes), {_learned_sql(f'SELECT word, n, {SPACED.format('letters')} AS s FROM spelled', ENCODED_MERGES)}
    SELECT word, replace(trim(s), '  ', ' ') AS pieces FROM w{ENCODED_MERGES}""",
)
def _(t):
    words = t.documents.select(F.explode(V.byte_pair_words(F.regexp_replace("text", r"\s+", " "))).alias("word"))
    frequencies = cut_lineage(words.groupBy("word").agg(F.count("*").alias("n")))
    merges = V.learn_merges(frequencies.select(V.byte_letters(F.col("word")).alias("word"), "n"), ENCODED_MERGES)
    return V.byte_pair_dictionary(frequencies, merges).select("word", F.array_join("pieces", " ").alias("pieces"))


@query(
    "voc05_byte_pair_words",
    r"""SELECT doc_id, unnest(range(len(ws)))::INTEGER AS pos, unnest(ws) AS word FROM (
      SELECT doc_id, regexp_extract_all(regexp_replace(text, '\s+', ' ', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+') AS ws FROM documents)""",
)
def _(t):
    text = F.regexp_replace("text", r"\s+", " ")
    return V.word_positions(t.documents, ["doc_id"], V.byte_pair_words(text))


@query(
    "voc06_decode_ids",
    f"""WITH {TOP_SQL}, placed AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM (SELECT doc_id, {words("text")} AS ws FROM documents))
    SELECT doc_id, string_agg(coalesce(v.token, '[UNK]'), ' ' ORDER BY i) AS text FROM placed LEFT JOIN vocab v ON v.token = word GROUP BY doc_id""",
)
def _(t):
    vocab = _vocab(t)
    table = F.broadcast(V.assemble_vocab(vocab, VOCAB_SIZE))
    encoded = V.encode_words(t.documents, ["doc_id"], T.split_words(F.col("text")), vocab, unk=VOCAB_SIZE + 4)
    return V.decode_ids(encoded, ["doc_id"], "tokens", table)


@query(
    "voc06_encode_words",
    f"""WITH {TOP_SQL}, placed AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM (SELECT doc_id, {words("text")} AS ws FROM documents)),
    encoded AS (SELECT doc_id, string_agg(coalesce(v.id, -1)::VARCHAR, ' ' ORDER BY i) AS tokens FROM placed LEFT JOIN vocab v ON v.token = word GROUP BY doc_id)
    SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN encoded USING (doc_id)""",
)
def _(t):
    encoded = V.encode_words(t.documents, ["doc_id"], T.split_words(F.col("text")), _vocab(t), unk=-1)
    return encoded.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("voc07_encode_chars", f"SELECT doc_id, {joined(codes('text'))} AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(V.encode_chars(F.col("text")), " ").alias("tokens"))


@query("voc07_decode_chars", "SELECT doc_id, text FROM documents")
def _(t):
    return t.documents.select("doc_id", V.decode_chars(V.encode_chars(F.col("text"))).alias("text"))


@query(
    "voc08_split_commands",
    f"""WITH marked AS (SELECT doc_id, regexp_replace(replace(replace(replace(text, ' of ', ' [MASK] '), ' the ', ' [MASK2] '), chr(10), '[SEP]'), '\\s+(\\[MASK2?\\])', '\\1', 'g') AS text FROM documents),
    cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\\[MASK2?\\]|\\[SEP\\])', chr(31) || '\\1' || chr(31), 'g'), chr(31)), lambda p: p <> '') AS ps FROM marked)
    SELECT doc_id, unnest(range(len(ps)))::INTEGER AS pos, unnest(ps) AS piece FROM cut""",
)
def _(t):
    marked = T.replace_all(F.col("text"), [(" of ", " [MASK] "), (" the ", " [MASK2] "), ("\n", "[SEP]")])
    return V.word_positions(t.documents, ["doc_id"], V.split_commands(marked, sentinels=3), "piece")


@query(
    "voc08_encode_commands",
    f"""WITH cut AS (SELECT doc_id, string_split(replace(text, ' of ', chr(31)), chr(31)) AS ps FROM documents)
    SELECT doc_id, {joined("flatten(list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN [] ELSE [50013] END || " + codes("CASE WHEN i < len(ps) THEN regexp_replace(p, '\\s+$', '') ELSE p END") + "))")} AS ids FROM cut""",
)
def _(t):
    marked = F.replace("text", F.lit(" of "), F.lit(" [MASK2]"))
    ids = V.encode_with_commands(marked, V.encode_chars, 50_000, sentinels=3, fixed_ids=True)
    return t.documents.select("doc_id", F.array_join(ids, " ").alias("ids"))


@query(
    "voc09_assembled_vocab",
    f"""WITH {TOP_SQL} SELECT NULL::VARCHAR AS name, token, id, false AS is_command FROM vocab UNION ALL
    SELECT name, token, {VOCAB_SIZE} + id, true FROM (VALUES ('pad', '<|endoftext|>', 0), ('eos', '<|endoftext|>', 0), ('sep', '[SEP]', 1), ('ENC', '[CLS]', 2),
      ('MASK', '[MASK]', 3), ('unk', '[UNK]', 4), ('sop', '<|startofpiece|>', 6), ('eop', '<|endofpiece|>', 7), ('gMASK', '[gMASK]', 7), ('sMASK', '[sMASK]', 8), ('dBLOCK', '[dBLOCK]', 9),
      ('MASK1', '[MASK1]', 10), ('sop1', '<|startofpiece1|>', 11)) AS v(name, token, id)""",
)
def _(t):
    return V.assemble_vocab(_vocab(t), VOCAB_SIZE, sentinels=2)


@query("voc09_padded_size", f"WITH {TOP_SQL} SELECT count(*) AS n_words, ((count(*) + 12 + 127) // 128 * 128) AS padded FROM freq")
def _(t):
    n_words = V.word_frequencies(t.documents).agg(F.count("*").alias("n_words"))
    return n_words.select("n_words", V.padded_size(F.col("n_words") + 12, 128).alias("padded"))


@query(
    "voc10_token_stats",
    f"SELECT count(*) AS n_docs, sum(len({words('text')}))::BIGINT AS n_tokens, sum(length(text))::BIGINT AS n_original FROM documents",
)
def _(t):
    docs = t.documents.select("text", T.split_words(F.col("text")).alias("tokens"))
    return V.token_stats(docs, "tokens", F.length("text"))


@query(
    "voc11_sentence_end_flags",
    f"""WITH {TOP_SQL} SELECT word AS token, regexp_matches(word, '[.?!;:\\n]') AS block, regexp_matches(word, '[.?!;:。？！；…\\n]') AS masking,
    regexp_matches(word, '[.?!]') AS causal FROM freq""",
)
def _(t):
    token = F.col("word")
    return V.word_frequencies(t.documents).select(
        token.alias("token"),
        V.sentence_end(token, V.SENTENCE_END_BLOCK).alias("block"),
        V.sentence_end(token, V.SENTENCE_END_MASKING).alias("masking"),
        V.sentence_end(token, V.SENTENCE_END_CAUSAL).alias("causal"),
    )


@query(
    "voc12_sentences",
    f"""WITH lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS ls FROM documents),
    sents AS (SELECT doc_id, flatten(list_transform(ls, lambda line: {SENTENCES_SQL.format("line")})) AS ss FROM lines)
    SELECT doc_id, unnest(range(len(ss)))::INTEGER AS pos, unnest(ss) AS sentence FROM sents""",
)
def _(t):
    return t.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
