"""Sequences cut, packed and windowed from character-level ids of `documents`."""

from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions import text as T
from tokenmill.operators import sequences as S
from tokenmill.operators.special import end_ids, special_tokens
from tokenmill.operators.vocab import SENTENCE_END_BLOCK, encode_chars
from tokenmill.plans.corpus import _regex_sql, _replace_sql
from tokenmill.plans.registry import query
from tokenmill.plans.sqltext import codes, h_below, h_uniform, joined, words
from tokenmill.plans.vocab import SENTENCES_SQL

SP = special_tokens()
L = 512
ENDS = end_ids(SENTENCE_END_BLOCK)


def _tokens(t, *more):
    return t.documents.select("doc_id", *more, encode_chars(F.col("text")).alias("tokens"))


def _items(t, as_text=False):
    """Documents whose first line is the prompt (no loss) and whose rest is the text; their characters are the tokens."""
    cut = F.greatest(F.instr("text", "\n"), F.lit(0))
    prompt, text = F.col("text").substr(F.lit(1), cut), F.col("text").substr(cut + 1, F.length("text"))
    item = S.from_prompt(prompt, text, F.length, S.digits) if as_text else S.from_prompt(encode_chars(prompt), encode_chars(text))
    return t.documents.select("doc_id", item.alias("i")).select("doc_id", "i.*")


def _show(df, *arrays):
    """Arrays as text, so that every engine compares them alike."""
    return df.select(*[F.array_join(c, " ").alias(c) if c in arrays else c for c in df.columns])


TOKS = f"toks AS (SELECT doc_id, text, {codes('text')} AS tokens, instr(text, chr(10)) AS cut FROM documents)"
ITEMS = f"{TOKS}, items AS (SELECT doc_id, tokens, list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN i <= cut THEN 0 ELSE 1 END) AS loss FROM toks)"


@query(
    "cor_items_from_prompt_and_text",
    f"WITH {ITEMS} SELECT doc_id, {joined('tokens')} AS tokens, {joined('loss')} AS loss_mask FROM items",
)
def _(t):
    return _show(_items(t), "tokens", "loss_mask")


@query(
    "seq01_contiguous_chunks",
    f"""WITH {ITEMS}, raw AS (SELECT doc_id, unnest(range(1, len(tokens) + 1)) AS i, unnest(tokens) AS tok, unnest(tokens[2 :] || [50000]) AS tgt, unnest(loss[2 :] || [1]) AS loss FROM items),
    flat AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) - 1 AS g FROM raw)
    SELECT g // {L} AS chunk, string_agg(tok::VARCHAR, ' ' ORDER BY g) || repeat(' 50000', {L} - count(*)) AS tokens,
      string_agg(tgt::VARCHAR, ' ' ORDER BY g) || repeat(' 50000', {L} - count(*)) AS target,
      string_agg(loss::VARCHAR, ' ' ORDER BY g) || repeat(' 0', {L} - count(*)) AS loss, least({L}, arg_min(i, g) - 1)::BIGINT AS history
    FROM flat GROUP BY g // {L}""",
)
def _(t):
    return _show(S.contiguous_chunks(_items(t, as_text=True), "doc_id", L, SP.eos, SP.pad, encode=encode_chars), "tokens", "target", "loss")


def _draws_sql(seed, n_draws, cost):
    """Weighted draws per sample, numbered, with what was drawn before; enough of them to fill any sample here."""
    return f"""{ITEMS}, owned AS (SELECT doc_id, len(tokens) AS n, sum(len(tokens)) OVER (ORDER BY doc_id) - len(tokens) AS lo, sum(len(tokens)) OVER (ORDER BY doc_id) AS hi FROM items),
    points AS (SELECT d.doc_id AS sample, k AS draw, {h_below("(SELECT sum(len(tokens))::BIGINT FROM items)", seed, "d.doc_id", "k")} AS point FROM documents d, range({n_draws}) r(k)),
    drawn AS (SELECT sample, draw, o.doc_id, n, coalesce(sum({cost}) OVER (PARTITION BY sample ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM points JOIN owned o ON point >= lo AND point < hi)"""


@query(
    "seq02_weighted_packing",
    f"""WITH {_draws_sql("pack", 40, "n + 1")},
    pieces AS (SELECT sample, draw, list_append(tokens, 50000) AS toks, list_append(loss, 1) AS ls, {L + 1} - before AS room,
        CASE WHEN draw = 0 AND n + 1 > {L + 1} THEN {h_below(f"greatest(n + 1 - {L + 1}, 0) + 1", "pack-start", "sample")} ELSE 0 END AS start
      FROM drawn JOIN items USING (doc_id) WHERE before < {L + 1})
    SELECT sample, {joined("flatten(list(toks[start + 1 : start + room] ORDER BY draw))")} AS tokens, {joined("flatten(list(ls[start + 1 : start + room] ORDER BY draw))")} AS loss_mask
    FROM pieces GROUP BY sample""",
)
def _(t):
    samples = t.documents.select(F.col("doc_id").alias("sample"))
    return _show(S.packed_sequences(samples, "sample", _items(t), "doc_id", L, SP.eos, SP.pad, "pack"), "tokens", "loss_mask")


_END_SQL = "(" + ", ".join(map(str, ENDS)) + ")"


@query(
    "seq03_block_samples",
    f"""WITH {_draws_sql("block", 40, "n + 2")},
    pieces AS (SELECT sample, draw, before, list_append(tokens, 50000) AS toks, list_append(loss, 1) AS ls, n + 1 AS size, (draw = 0 AND n + 1 >= {L}) AS long,
        {h_below(f"greatest(n + 1 - {L} + 1, 1)", "block-start", "sample")} AS start FROM drawn JOIN items USING (doc_id) WHERE before < {L}),
    flagged AS (SELECT *, list_filter(range(1, len(toks) + 1), lambda i: toks[i] IN {_END_SQL}) AS ends FROM pieces),
    moved AS (SELECT *, CASE WHEN NOT long THEN 0 WHEN NOT {h_uniform("block-move", "sample")} > 0.25 THEN start
        WHEN {h_uniform("block-side", "sample")} < 0.5 THEN greatest(coalesce(list_max(list_filter(ends, lambda e: e <= start)), 0), start - {L // 2})
        ELSE least(coalesce(list_min(list_filter(ends, lambda e: e >= start)), size), start + {L // 2}, size) END AS s,
        CASE WHEN long THEN {L} ELSE {L} - before END AS room FROM flagged),
    cut AS (SELECT *, [50002] || toks[s + 1 :] AS seq, [0] || ls[s + 1 :] AS seq_ls FROM moved),
    kept AS (SELECT *, CASE WHEN len(seq) <= room THEN len(seq) ELSE greatest(coalesce(list_max(list_filter(range(1, len(seq) + 1), lambda i: i <= room AND seq[i] IN {_END_SQL})), 1), 1) END AS k0 FROM cut),
    final AS (SELECT *, CASE WHEN long AND len(seq) = 2 AND seq[2] = 50000 THEN 0 WHEN len(seq) > room AND k0 < room // 2 THEN room ELSE k0 END AS k FROM kept)
    SELECT sample, {joined("flatten(list(seq[1 : k] ORDER BY draw))")} AS tokens, {joined("flatten(list(seq_ls[1 : k] ORDER BY draw))")} AS loss_mask FROM final GROUP BY sample""",
)
def _(t):
    samples = t.documents.select(F.col("doc_id").alias("sample"))
    df = S.block_samples(samples, "sample", _items(t), "doc_id", L, SP.cls, SP.eos, ENDS, "block", non_sentence_start=0.25)
    return _show(df, "tokens", "loss_mask")


def _sentence_docs(t):
    sents = F.transform(T.sentences(F.col("text")), lambda s: encode_chars(s))
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("weight"), sents.alias("sentences"))


# The first good one of 24 tries is taken; more are needed once in 2^24 samples.
PAIRS_SQL = f"""sents AS (SELECT doc_id, unnest(range(len(ss))) AS j, unnest(ss) AS s FROM (
      SELECT doc_id, flatten(list_transform(list_filter(string_split(text, chr(10)), lambda l: l <> ''), lambda line: {SENTENCES_SQL.format("line")})) AS ss FROM documents)),
    sized AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY j) AS hi, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY j) - length(s) AS lo FROM sents),
    ends AS (SELECT doc_id, count(*) AS m, max(hi) AS total FROM sized GROUP BY doc_id),
    heads AS (SELECT doc_id AS doc, m, total, sum(length(text)) OVER (ORDER BY doc_id) AS whi, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS wlo,
      row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS docs FROM documents JOIN ends USING (doc_id)),
    wanted AS (SELECT doc_id AS sample, CASE WHEN {h_uniform("pairs-short", "doc_id")} < 0.1 THEN 2 + {h_below(127, "pairs-length", "doc_id")} ELSE 128 END AS target FROM documents),
    tries AS (SELECT *, unnest(range(24)) AS k FROM wanted),
    points AS (SELECT t.*, {h_below("w", "pairs", "sample", "k")} AS p FROM tries t, (SELECT max(whi) AS w FROM heads)),
    drawn AS (SELECT p.*, h.*, {h_below("m", "pairs-a", "sample", "k")} AS number FROM points p JOIN heads h ON h.wlo <= p.p AND p.p < h.whi),
    placed AS (SELECT d.*, s.lo AS lo, least(s.lo + target, total) - 1 AS point FROM drawn d JOIN sized s ON s.doc_id = d.doc AND s.j = d.number),
    reached AS (SELECT d.*, s.j AS last, s.j - d.number + 1 AS taken FROM placed d JOIN sized s ON s.doc_id = d.doc AND s.lo <= d.point AND d.point < s.hi),
    parts AS (SELECT *, CASE WHEN taken >= 2 THEN {h_below("taken + 1", "pairs-cut", "sample", "k")} ELSE 1 END AS num_a, taken = 1 OR {h_uniform("pairs-next", "sample", "k")} < 0.5 AS is_random FROM reached),
    good AS (SELECT * FROM parts WHERE num_a >= 1 AND (is_random OR num_a < taken) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY k) = 1),
    firsts AS (SELECT g.sample, string_agg(s.s, '' ORDER BY s.j) AS a FROM good g JOIN sized s ON s.doc_id = g.doc AND s.j BETWEEN g.number AND g.number + g.num_a - 1 GROUP BY g.sample),
    others AS (SELECT g.sample, g.k, g.target - length(a) AS need, h.doc AS other, h.total, {h_below("h.m", "pairs-b", "g.sample", "g.k")} AS from_b FROM good g JOIN firsts USING (sample)
      JOIN heads h ON h.pos = {h_below("g.docs - 1", "pairs-other", "g.sample", "g.k")} + CASE WHEN {h_below("g.docs - 1", "pairs-other", "g.sample", "g.k")} >= g.pos THEN 1 ELSE 0 END WHERE is_random),
    aimed AS (SELECT o.*, least(s.lo + greatest(need, 1), o.total) - 1 AS point FROM others o JOIN sized s ON s.doc_id = o.other AND s.j = o.from_b),
    ranges AS (SELECT a.sample, a.other AS doc, a.from_b AS j0, s.j AS j1 FROM aimed a JOIN sized s ON s.doc_id = a.other AND s.lo <= a.point AND a.point < s.hi
      UNION ALL SELECT sample, doc, number + num_a, last FROM good WHERE NOT is_random),
    seconds AS (SELECT r.sample, string_agg(s.s, '' ORDER BY s.j) AS b FROM ranges r JOIN sized s ON s.doc_id = r.doc AND s.j BETWEEN r.j0 AND r.j1 GROUP BY r.sample)"""


@query("seq04_sentence_pairs", f"WITH {PAIRS_SQL} SELECT sample, is_random, {joined(codes('a'))} AS tokens_a, {joined(codes('b'))} AS tokens_b FROM good JOIN firsts USING (sample) JOIN seconds USING (sample)")
def _(t):
    samples = t.documents.select(F.col("doc_id").alias("sample"))
    return _show(S.sentence_pairs(samples, "sample", _sentence_docs(t), "doc_id", 128, "pairs", short_prob=0.1), "tokens_a", "tokens_b")


@query(
    "seq05_truncate_pair",
    f"""WITH {TOKS}, pairs AS (SELECT doc_id, list_slice(tokens, 1, cut) AS a, list_slice(tokens, cut + 1, len(tokens)) AS b FROM toks),
    sized AS (SELECT *, greatest(len(a) + len(b) - 125, 0) AS k, abs(len(a) - len(b)) AS d FROM pairs),
    losses AS (SELECT *, CASE WHEN len(a) > len(b) THEN least(k, d) ELSE 0 END + (k - least(k, d)) // 2 AS la FROM sized),
    fronts AS (SELECT *, k - la AS lb, len(list_filter(range(la), lambda i: {h_uniform("trim-a", "doc_id", "i")} < 0.5)) AS fa,
      len(list_filter(range(k - la), lambda i: {h_uniform("trim-b", "doc_id", "i")} < 0.5)) AS fb FROM losses)
    SELECT doc_id, {joined("list_slice(a, fa + 1, len(a) - la + fa)")} AS tokens_a, {joined("list_slice(b, fb + 1, len(b) - lb + fb)")} AS tokens_b FROM fronts""",
)
def _(t):
    # Characters are the tokens, so the texts are cut and what is left is encoded.
    cut = F.instr("text", "\n")
    df = t.documents.select("doc_id", F.left("text", cut).alias("tokens_a"), F.col("text").substr(cut + 1, F.length("text")).alias("tokens_b"))
    df = S.truncate_pair(df, "doc_id", 125, "trim", size=F.length, take=lambda text, start, count: text.substr(start + 1, count))
    return _show(df.withColumns({c: encode_chars(F.col(c)) for c in ("tokens_a", "tokens_b")}), "tokens_a", "tokens_b")


WINDOWS = """windows AS (SELECT doc_id, unnest(range((greatest(len(tokens) - 256, 0) + 63) // 64 + 1)) AS w,
  unnest(list_transform(range((greatest(len(tokens) - 256, 0) + 63) // 64 + 1), lambda w: list_slice(tokens, w * 64 + 1, w * 64 + 256))) AS toks FROM toks)"""


@query(
    "seq06_sliding_windows",
    f"""WITH {TOKS}, {WINDOWS} SELECT doc_id, w::INTEGER AS "window", {joined("list_resize(toks, 256, 0)")} AS tokens,
      {joined("list_transform(range(1, 257), lambda i: CASE WHEN i <= len(toks) AND (w = 0 OR i > 192) THEN 1 ELSE 0 END)")} AS loss_mask FROM windows""",
)
def _(t):
    written = _tokens(t).withColumn("tokens", F.col("tokens").cast("array<string>"))  # once for the four windows of a token
    return S.sliding_windows(written, ["doc_id"], 256, 64, pad="0", form=lambda a: F.array_join(a, " "))


@query(
    "seq06_blank_windows",
    f"""WITH {TOKS}, {WINDOWS} SELECT doc_id, w::INTEGER AS "window", {joined("list_slice(toks, 1, CASE WHEN w = 0 THEN 1 ELSE 192 END)")} AS prompt,
      {joined("list_slice(toks, CASE WHEN w = 0 THEN 2 ELSE 193 END, 256)")} AS text FROM windows""",
)
def _(t):
    return _show(S.blank_windows(_tokens(t), ["doc_id"], 256, 64), "prompt", "text")


@query(
    "seq07_last_word_cloze",
    f"""WITH w AS (SELECT doc_id, text, {words("text")} AS ws FROM documents)
    SELECT doc_id, trim(left(rtrim(text, ' ' || chr(10)), length(rtrim(text, ' ' || chr(10))) - length(ws[-1])), ' ' || chr(10)) AS context, ws[-1] AS answer FROM w""",
)
def _(t):
    return t.documents.select("doc_id", S.last_word_cloze(F.col("text")).alias("c")).select("doc_id", "c.*")


@query(
    "seq07_last_token_cloze",
    f"WITH {TOKS} SELECT doc_id, {joined('list_slice(tokens, 1, len(tokens) - 1)')} AS context, tokens[-1] AS answer FROM toks",
)
def _(t):
    return _show(_tokens(t).select("doc_id", S.last_token_cloze(F.col("tokens")).alias("c")).select("doc_id", "c.*"), "context")


DETOKENIZED_SQL = _replace_sql(_regex_sql(_replace_sql("text", T.WIKITEXT_RULES_BEFORE), T.WIKITEXT_BRACKET_RULES), T.WIKITEXT_RULES_AFTER)


@query(
    "tsk33_whole_file_windows",
    f"""WITH d AS (SELECT doc_id, {codes(f"({DETOKENIZED_SQL})")} AS t FROM documents), placed AS (SELECT t, sum(len(t)) OVER (ORDER BY doc_id) - len(t) AS lo FROM d),
    toks AS (SELECT lo + unnest(range(len(t))) AS g, unnest(t) AS x FROM placed),
    pieces AS (SELECT g // 256 AS w, string_agg(x::VARCHAR, ' ' ORDER BY g) AS s, count(*) AS n FROM toks GROUP BY 1),
    windows AS (SELECT w, concat_ws(' ', s, lead(s, 1) OVER o, lead(s, 2) OVER o, lead(s, 3) OVER o) AS s, sum(n) OVER (ORDER BY w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n, sum(n) OVER () AS total FROM pieces WINDOW o AS (ORDER BY w))
    SELECT w::BIGINT AS "window", n::INTEGER AS n_tokens, md5(concat_ws(' ', s, CASE WHEN n < 1024 THEN {joined("list_resize([]::INTEGER[], 1024 - n, 0)")} END)) AS tokens,
      md5({joined("list_transform(range(1, 1025), lambda i: CASE WHEN i <= n AND (w = 0 OR i > 768) THEN 1 ELSE 0 END)")}) AS loss_mask FROM windows WHERE w <= ceil(greatest(total - 1024, 0) / 256)""",
)
def _(t):
    docs = t.documents.select("doc_id", T.detokenize_wikitext(F.col("text")).alias("tokens"))
    df = S.stream_windows(docs, "doc_id", 1024, 256, encode=encode_chars)
    return df.select("window", F.size(F.filter("tokens", lambda c: c > 0)).alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens"), F.md5(F.array_join("loss_mask", " ")).alias("loss_mask"))


@query(
    "tsk33_last_word_set",
    f"""WITH w AS (SELECT doc_id, text, {words("text")} AS ws FROM documents),
    c AS (SELECT doc_id, trim(left(rtrim(text, ' ' || chr(10)), length(rtrim(text, ' ' || chr(10))) - length(ws[-1])), ' ' || chr(10)) AS context, ws[-1] AS answer FROM w)
    SELECT doc_id, {joined(codes("context"))} AS tokens, {joined(codes("' ' || answer"))} AS labels FROM c""",
)
def _(t):
    cloze = t.documents.select("doc_id", S.last_word_cloze(F.col("text")).alias("c"))
    return _show(cloze.select("doc_id", encode_chars(F.col("c.context")).alias("tokens"), encode_chars(F.concat(F.lit(" "), "c.answer")).alias("labels")), "tokens", "labels")


# Questions about a document: the answer is its tenth word, or a word it does not hold.
QA_SQL = f"""qa AS (SELECT doc_id, text AS context, (length(source) + 20)::INTEGER AS question_size,
  CASE WHEN doc_id % 5 = 0 THEN 'zzz' ELSE coalesce({words("text")}[10], '') END AS answer FROM documents)"""


def _qa(t):
    return t.documents.select(
        "doc_id", F.col("text").alias("context"), (F.length("source") + 20).alias("question_size"),
        F.when(F.col("doc_id") % 5 == 0, "zzz").otherwise(F.coalesce(F.get(T.split_words(F.col("text")), F.lit(9)), F.lit(""))).alias("answer"))


def _passages_sql(answer_required):
    keep = "found" if answer_required else "true"
    return f"""WITH {QA_SQL}, cut AS (SELECT doc_id, answer, question_size, unnest(range(0, length(context), 200)) AS start,
      unnest(list_transform(range(0, length(context), 200), lambda s: substr(context, s + 1, 397 - question_size))) AS text FROM qa),
    ws AS (SELECT *, length(text) < 397 - question_size AS short FROM cut),
    found AS (SELECT *, answer <> '' AND contains(text, answer) AS found FROM ws),
    stops AS (SELECT *, count(*) FILTER (WHERE short) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM found WHERE {keep})
    SELECT doc_id, start::INTEGER AS start, text, CASE WHEN found THEN answer ELSE 'N/A' END AS label FROM stops WHERE stopped = 0"""


@query("seq08_passage_windows", _passages_sql(False))
def _(t):
    return S.passage_windows(_qa(t), ["doc_id"], 400)


@query("seq08_passage_windows_answerable", _passages_sql(True))
def _(t):
    return S.passage_windows(_qa(t), ["doc_id"], 400, answer_required=True)


SENTS = "list_filter(string_split(regexp_replace({}, '([.?!])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')"


@query(
    "seq09_sections",
    f"""WITH raw AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    lines AS (SELECT doc_id, i, {SENTS.format("line")} AS ss FROM raw WHERE i > 0),
    marked AS (SELECT *, sum(CASE WHEN len(ss) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM lines WHERE len(ss) > 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island, len(ss) > 1 ORDER BY i) AS r, count(*) OVER (PARTITION BY doc_id, island, len(ss) > 1) AS n FROM marked),
    placed AS (SELECT *, CASE WHEN len(ss) > 1 THEN island * 2 WHEN n = 1 AND island > 0 THEN island * 2 ELSE island * 2 + 1 END AS section FROM numbered)
    SELECT doc_id, section::BIGINT AS section, arg_min(ss[1], i) AS key_sentence,
      array_to_string(list_slice(flatten(list(ss ORDER BY i)), 2, 1000000), ' ') AS content FROM placed GROUP BY doc_id, section""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("line_no > 0")
    return S.sections(lines.select("doc_id", "line_no", T.sentences(F.col("line")).alias("sentences")), "doc_id")


@query(
    "seq10_around_answer",
    f"""WITH w AS (SELECT doc_id, {words("text")} AS ws FROM documents), p AS (SELECT *, list_slice(ws, len(ws) // 2 + 1, len(ws) // 2 + 2) AS pat FROM w),
    f AS (SELECT *, list_min(list_filter(range(len(ws)), lambda i: list_slice(ws, i + 1, i + len(pat)) = pat)) AS hit FROM p),
    s AS (SELECT *, CASE WHEN hit IS NULL THEN 0 ELSE greatest(hit - 25, 0) END AS start FROM f)
    SELECT doc_id, {joined("CASE WHEN len(ws) > 50 THEN list_slice(ws, start + 1, start + 50) ELSE ws END")} AS tokens FROM s""",
)
def _(t):
    ws = t.documents.select("doc_id", T.split_words(F.col("text")).alias("ws"))
    pattern = A.take(F.col("ws"), F.floor(F.size("ws") / 2), 2)
    return _show(ws.select("doc_id", S.around_answer(F.col("ws"), pattern, 50).alias("tokens")), "tokens")


@query(
    "seq11_fit_and_tail",
    f"WITH {TOKS} SELECT doc_id, {joined('list_resize(tokens, 300, 50000)')} AS fitted, {joined('list_slice(tokens, greatest(len(tokens) - 100, 0) + 1, len(tokens))')} AS tail FROM toks",
)
def _(t):
    df = _tokens(t)
    return _show(df.select("doc_id", A.fit(F.col("tokens"), 300, SP.pad).alias("fitted"), A.tail(F.col("tokens"), 100).alias("tail")), "fitted", "tail")


@query(
    "seq11_pad_batch",
    f"""WITH raw AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    enc AS (SELECT doc_id, line_no, {codes("line")} AS tokens FROM raw)
    SELECT doc_id, line_no, {joined("list_resize(tokens, max(len(tokens)) OVER (PARTITION BY doc_id, line_no // 8), 50000)")} AS tokens FROM enc""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    batch = F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("line_no") / 8).cast("string"))
    df = lines.select("doc_id", "line_no", batch.alias("batch"), encode_chars(F.col("line")).alias("tokens"))
    return _show(S.pad_batch(df, "batch", "tokens", SP.pad).drop("batch"), "tokens")


@query(
    "seq12_loss_from_runs",
    """WITH runs AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: length(l)) AS runs FROM documents)
    SELECT doc_id, array_to_string(flatten(list_transform(runs, lambda n, i: list_resize([]::INTEGER[], n, ((i - 1) % 2)::INTEGER))), ' ') AS loss_mask FROM runs""",
)
def _(t):
    runs = t.documents.select("doc_id", F.transform(F.split("text", "\n"), lambda line: F.length(line)).alias("runs"))
    return _show(runs.select("doc_id", S.loss_from_runs(F.col("runs")).alias("loss_mask")), "loss_mask")


@query(
    "seq13_segments",
    f"""WITH {TOKS}, raw AS (SELECT doc_id, unnest(range(len(tokens))) AS g, unnest(tokens) AS tok FROM toks),
    flat AS (SELECT doc_id, g // 512 AS w, g AS i, coalesce(sum(CASE WHEN tok = 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g // 512 ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM raw),
    pos AS (SELECT *, i - min(i) OVER (PARTITION BY doc_id, w, seg) AS pos FROM flat)
    SELECT doc_id, w::INTEGER AS piece, string_agg(seg::BIGINT::VARCHAR, ' ' ORDER BY i) AS segment, string_agg(pos::VARCHAR, ' ' ORDER BY i) AS position FROM pos GROUP BY doc_id, w""",
)
def _(t):
    cuts = F.transform(A.counting(0, F.ceil(F.size("tokens") / 512).cast("int")), lambda w: A.take(F.col("tokens"), w * 512, 512))
    pieces = _tokens(t).select("doc_id", F.posexplode(cuts).alias("piece", "tokens"))
    df = pieces.select("doc_id", "piece", S.segments(F.col("tokens"), ord("\n")).alias("s"))
    return _show(df.select("doc_id", "piece", F.col("s.segment").alias("segment"), F.col("s.position").alias("position")), "segment", "position")
