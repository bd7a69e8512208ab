"""Masked and blank-filling examples from character-level samples of `documents`.

A sample is cls and 255 character ids of one document, where line ends stand for document ends (eos), so that most samples
hold several documents. Sixteen samples of a document make a batch. Keys are text, `doc_id-piece`, so no two samples share one.
"""

from dataclasses import replace

from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions import text as T
from tokenmill.operators import blanks as B
from tokenmill.operators.sequences import pad_batch
from tokenmill.operators.special import end_ids, special_tokens
from tokenmill.operators.vocab import SENTENCE_END_MASKING
from tokenmill.plans.registry import query
from tokenmill.plans.sequences import _show
from tokenmill.plans.sqltext import codes, h_below, h_hex, h_uniform, joined, words

SP = special_tokens(sentinels=40)
ENDS = end_ids(SENTENCE_END_MASKING.replace("\n", ""))
SAMPLE = 255
LAYOUT = ("text", "target", "loss_mask", "position", "block_position")


def _samples(t):
    # Texts are cut into the samples' characters first, so that no array is as long as a document.
    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SAMPLE}}}"), F.lit(0))
    ids = lambda cut: F.transform(F.split(cut, ""), lambda c: F.when(c == "\n", SP.eos).otherwise(F.ascii(c)))
    pieces = t.documents.select("doc_id", F.posexplode(F.transform(cuts, lambda cut: F.concat(F.array(F.lit(SP.cls)), ids(cut)))).alias("piece", "tokens"))
    return pieces.select(
        F.concat_ws("-", "doc_id", "piece").alias("sample"),
        F.concat_ws("-", "doc_id", F.floor(F.col("piece") / 16)).alias("batch"),
        "tokens",
        F.concat(F.array(F.lit(0)), A.repeat(1, F.size("tokens") - 1)).alias("loss_mask"),
    )


SAMPLES = f"""toks AS (SELECT doc_id, list_transform({codes("text")}, lambda c: CASE WHEN c = 10 THEN 50000 ELSE c END) AS ids FROM documents),
cuts AS (SELECT doc_id, unnest(range((len(ids) + 254) // 255)) AS piece, unnest(list_transform(range((len(ids) + 254) // 255), lambda w: [50002] || ids[w * 255 + 1 : w * 255 + 255])) AS tokens FROM toks),
samples AS (SELECT doc_id || '-' || piece AS sample, doc_id || '-' || piece // 16 AS batch, tokens, len(tokens)::INTEGER AS n FROM cuts)"""


def _with_spans(df):
    """Three tokens out of every ten are blanked, from the fourth token on."""
    count = F.floor((F.size("tokens") - 1) / 10).cast("int")
    return df.withColumn("spans", F.transform(A.counting(0, count), lambda k: F.struct((k * 10 + 4).cast("int").alias("start"), (k * 10 + 7).cast("int").alias("end"))))


SPANNED = f"{SAMPLES}, spanned AS (SELECT *, range((n - 1) // 10) AS ks FROM samples)"


def _ranked(seed):
    return f"list_transform(list_sort(list_transform(ks, lambda k: {{'h': {h_hex(seed, 'sample', 'k * 10 + 4')}, 'k': k}})), lambda x: x.k)"


SOURCE = "flatten(list_transform(ks, lambda k: tokens[CASE WHEN k = 0 THEN 1 ELSE k * 10 - 2 END : k * 10 + 4] || [50003])) || CASE WHEN len(ks) = 0 THEN tokens ELSE tokens[len(ks) * 10 - 2 :] END"


@query(
    "obj01_objective",
    f"""WITH {SAMPLES}, b AS (SELECT DISTINCT batch FROM samples), u AS (SELECT batch, {h_uniform("o-single", "batch")} < 0.1 AS single_span, {h_uniform("o-objective", "batch")} AS u FROM b)
    SELECT batch, CASE WHEN single_span OR u < 0.5 THEN 'bert' WHEN u < 0.7 THEN 'sentence' ELSE 'gpt' END AS mode, single_span FROM u""",
)
def _(t):
    batches = _samples(t).select("batch").distinct()
    return batches.select("batch", B.objective("batch", "o", 0.5, 0.2, 0.1).alias("o")).select("batch", "o.*")


CDF = B.span_length_cdf()
CDF_SQL = "[" + ", ".join(f"{c!r}::DOUBLE" for c in CDF) + "]"


@query(
    "obj02_span_lengths",
    f"""WITH {SAMPLES}, draws AS (SELECT sample, floor(0.15::DOUBLE * n)::INTEGER AS target, i, least(len(list_filter({CDF_SQL}, lambda c: c <= {h_uniform("len", "sample", "i")})) + 1, 39) AS len
      FROM samples, range(38) r(i)),
    totals AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM draws)
    SELECT sample, coalesce(string_agg(len::VARCHAR, ' ' ORDER BY i) FILTER (WHERE before < target), '') AS lengths FROM totals GROUP BY sample""",
)
def _(t):
    return _samples(t).select("sample", F.array_join(B.span_lengths("sample", F.size("tokens"), 0.15, "len", CDF), " ").alias("lengths"))


# Lengths 1, 2, 3, … per sample, as many as a tenth of its tokens can hold.
@query(
    "obj03_span_places",
    f"""WITH {SAMPLES}, ls AS (SELECT sample, n, range(1, 2 + n // 64) AS lens FROM samples),
    sums AS (SELECT *, greatest(n - list_sum(lens) - len(lens) + 2, 1) AS room FROM ls),
    places AS (SELECT *, list_sort(list_transform(range(len(lens)), lambda i: {h_below("room", "place", "sample", "i")})) AS ps FROM sums),
    spans AS (SELECT sample, list_transform(lens, lambda l, i: ps[i] + coalesce(list_sum(lens[1 : i - 1]), 0) + i - 1) AS starts, lens FROM places)
    SELECT sample, array_to_string(list_transform(starts, lambda s, i: s::BIGINT::VARCHAR || '-' || (s + lens[i])::BIGINT::VARCHAR), ' ') AS spans FROM spans""",
)
def _(t):
    lengths = A.counting(1, 1 + F.floor(F.size("tokens") / 64).cast("int"))
    spans = B.place_spans(lengths, F.size("tokens"), F.lit(0), "place", "sample")
    text = F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return _samples(t).select("sample", F.array_join(text, " ").alias("spans"))


@query("obj04_spans_over_documents")
def _(t):
    df = B.token_blanks(_samples(t), "sample", SP, "spread")
    text = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return df.select("sample", "batch", F.array_join(text, " ").alias("spans"))


@query(
    "obj05_blank_layout",
    f"""WITH {SPANNED}, ranked AS (SELECT *, {_ranked("lay-order")} AS rs, {SOURCE} AS source FROM spanned)
    SELECT sample, len(source)::INTEGER AS sep,
      {joined("source || flatten(list_transform(rs, lambda k: [50006] || tokens[k * 10 + 5 : k * 10 + 7]))")} AS text,
      {joined("source || flatten(list_transform(rs, lambda k: tokens[k * 10 + 5 : k * 10 + 7] || [50007]))")} AS target,
      {joined("list_transform(source, lambda x: 0) || flatten(list_transform(rs, lambda k: [1, 1, 1, 1]))")} AS loss_mask,
      {joined("range(len(source)) || flatten(list_transform(rs, lambda k: [k * 8 + 4, k * 8 + 4, k * 8 + 4, k * 8 + 4]))")} AS position,
      {joined("list_transform(source, lambda x: 0) || flatten(list_transform(rs, lambda k: [1, 2, 3, 4]))")} AS block_position FROM ranked""",
)
def _(t):
    df = B.blank_layout(_with_spans(_samples(t)), "sample", SP, "lay")
    return _show(df.select("sample", "sep", *LAYOUT), *LAYOUT)


@query(
    "obj06_sentinel_layout",
    f"""WITH {SPANNED}, ranked AS (SELECT *, {_ranked("sen-order")} AS rs FROM spanned),
    marked AS (SELECT *, flatten(list_transform(ks, lambda k: tokens[CASE WHEN k = 0 THEN 1 ELSE k * 10 - 2 END : k * 10 + 4] || [CASE WHEN list_position(rs, k) = 1 THEN 50003 ELSE 50009 + 2 * (list_position(rs, k) - 1) END]))
      || CASE WHEN len(ks) = 0 THEN tokens ELSE tokens[len(ks) * 10 - 2 :] END AS source FROM ranked)
    SELECT sample, len(source)::INTEGER AS sep,
      {joined("source || flatten(list_transform(rs, lambda k, i: [CASE WHEN i = 1 THEN 50006 ELSE 50010 + 2 * (i - 1) END] || tokens[k * 10 + 5 : k * 10 + 7]))")} AS text,
      {joined("range(len(source)) || flatten(list_transform(rs, lambda k: [512, 512, 512, 512]))")} AS position FROM marked""",
)
def _(t):
    df = B.blank_layout(_with_spans(_samples(t)), "sample", SP, "sen", sentinels=True, max_length=512)
    return _show(df.select("sample", "sep", "text", "position"), "text", "position")


@query(
    "obj07_span_corruption",
    f"""WITH {SPANNED}, ranked AS (SELECT *, {_ranked("dirty-order")} AS rs, {SOURCE} AS source FROM spanned)
    SELECT sample, {joined("source || flatten(list_transform(rs, lambda k: [50006] || list_transform([k * 10 + 4, k * 10 + 5, k * 10 + 6], lambda i: CASE WHEN " + h_uniform("dirty-span", "sample", "i") + " < 0.3 THEN 50010 ELSE tokens[i + 1] END)))")} AS text FROM ranked""",
)
def _(t):
    df = B.blank_layout(_with_spans(_samples(t)), "sample", SP, "dirty", span_corruption=0.3)
    return _show(df.select("sample", "text"), "text")


@query(
    "obj08_context_corruption",
    f"""WITH {SPANNED}, sourced AS (SELECT *, {SOURCE} AS source FROM spanned),
    near AS (SELECT *, list_distinct(flatten(list_transform(range(len(ks) + CASE WHEN len(ks) * 10 - 3 < n OR len(ks) = 0 THEN 1 ELSE 0 END), lambda g:
        list_filter(range(CASE WHEN g = 0 THEN 0 ELSE g * 8 - 3 END, CASE WHEN g = len(ks) THEN len(source) ELSE g * 8 + 4 END),
          lambda p: (g > 0 AND p < g * 8 - 3 + 3) OR p >= CASE WHEN g = len(ks) THEN len(source) ELSE g * 8 + 4 END - 3)))) AS cand FROM sourced),
    picked AS (SELECT *, list_transform(list_sort(list_transform(cand, lambda p: {{'h': {h_hex("ctx-context", "sample", "p")}, 'p': p}}))[1 : floor(0.05::DOUBLE * n)::INTEGER], lambda x: x.p) AS ps FROM near)
    SELECT sample, {joined("list_transform(source, lambda x, i: CASE WHEN list_contains(ps, i - 1) THEN 50010 ELSE x END)")} AS source FROM picked""",
)
def _(t):
    df = B.blank_layout(_with_spans(_samples(t)), "sample", SP, "ctx", context_corruption=0.05)
    return _show(df.select("sample", A.head(F.col("text"), F.col("sep")).alias("source")), "source")


@query(
    "obj09_random_position",
    f"""WITH {SPANNED}, sourced AS (SELECT sample, ks, len({SOURCE}) AS sep FROM spanned),
    biased AS (SELECT *, CASE WHEN sep - 1 < 511 THEN {h_below("512 - (sep - 1)", "pos-bias", "sample")} ELSE 0 END AS bias FROM sourced)
    SELECT sample, sep::INTEGER AS sep, {joined("range(bias, sep + bias)")} AS position FROM biased""",
)
def _(t):
    df = B.blank_layout(_with_spans(_samples(t)), "sample", SP, "pos", random_position=True, max_length=512)
    return _show(df.select("sample", "sep", A.head(F.col("position"), F.col("sep")).alias("position")), "position")


@query(
    "obj10_masked_in_place",
    f"""WITH {SPANNED}, flags AS (SELECT *, list_transform(range(n), lambda i: i % 10 IN (4, 5, 6) AND i // 10 < len(ks)) AS inside FROM spanned)
    SELECT sample, {joined("list_transform(tokens, lambda x, i: CASE WHEN inside[i] THEN 50003 ELSE x END)")} AS text, {joined("tokens")} AS target,
      {joined("list_transform(inside, lambda b: b::INTEGER)")} AS loss_mask FROM flags""",
)
def _(t):
    return _show(B.masked_layout(_with_spans(_samples(t)), SP).select("sample", "text", "target", "loss_mask"), "text", "target", "loss_mask")


@query(
    "obj11_sentence_blanks",
    f"""WITH {SAMPLES}, flat AS (SELECT sample, n, unnest(range(n)) AS i, unnest(tokens) AS x FROM samples),
    ends AS (SELECT sample, n, i, x, x IN ({", ".join(map(str, ENDS))}) AS stop, x = 50000 AS eos FROM flat),
    bounds AS (SELECT sample, n, i, stop FROM ends WHERE stop OR eos UNION ALL SELECT sample, n, n AS i, true FROM samples),
    spans AS (SELECT sample, n, coalesce(lag(i) OVER (PARTITION BY sample ORDER BY i) + 1, 1) AS a, least(i + 1, n) AS b, stop FROM bounds),
    kept AS (SELECT *, {h_hex("sent", "sample", "a")} AS h FROM spans WHERE stop AND a < b),
    running AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY sample ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY sample ORDER BY h) AS r FROM kept),
    chosen AS (SELECT sample, string_agg(a::VARCHAR || '-' || b::VARCHAR, ' ' ORDER BY h) AS spans FROM running WHERE r = 1 OR before < floor(0.15::DOUBLE * n) GROUP BY sample)
    SELECT sample, coalesce(spans, '') AS spans FROM samples LEFT JOIN chosen USING (sample)""",
)
def _(t):
    spans = B.sentence_spans("sample", F.col("tokens"), ENDS, SP.eos, SP.cls, 0.15, "sent")
    text = F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return _samples(t).select("sample", F.array_join(text, " ").alias("spans"))


@query("obj11_sentence_layout")
def _(t):
    spans = B.sentence_spans("sample", F.col("tokens"), ENDS, SP.eos, SP.cls, 0.15, "sent")
    df = B.blank_layout(_samples(t).withColumn("spans", spans), "sample", SP, "sent", mask_id=SP.smask)
    return _show(df.select("sample", "sep", *LAYOUT), *LAYOUT)


@query(
    "obj12_generation_suffix",
    f"""WITH {SAMPLES}, drawn AS (SELECT *, floor(0.5::DOUBLE * min(n) OVER (PARTITION BY batch))::INTEGER AS lo, max(n) OVER (PARTITION BY batch) - 2 AS hi FROM samples),
    sized AS (SELECT *, least(lo + {h_below("greatest(hi - lo + 1, 1)", "gen-length", "batch")}, n - 2) AS g FROM drawn),
    suffix AS (SELECT *, n - g AS kept FROM sized WHERE (list_contains(tokens, 50000) AND list_position(tokens, 50000) < n) OR {h_uniform("gen-infill", "sample")} < 0.5)
    SELECT sample, (kept + 1)::INTEGER AS sep, {joined("tokens[1 : kept] || [50009, 50006] || tokens[kept + 1 : n - 1]")} AS text, {joined("tokens[1 : kept] || [50009] || tokens[kept + 1 :]")} AS target,
      {joined("list_transform(range(n + 1), lambda i: least(i, kept))")} AS position, {joined("list_transform(range(n + 1), lambda i: greatest(i - kept, 0))")} AS block_position,
      {joined("list_transform(range(n + 1), lambda i: CASE WHEN i <= kept THEN 0 ELSE 1 END)")} AS loss_mask FROM suffix WHERE g > 0""",
)
def _(t):
    df = B.generation_layout(_samples(t), "sample", "batch", SP, "gen").filter("suffix").filter(F.col("sep") < F.size("target"))
    return _show(df.select("sample", "sep", *LAYOUT), *LAYOUT)


@query("obj12_generation")
def _(t):
    df = B.generation_layout(_samples(t), "sample", "batch", SP, "gen")
    return _show(df.select("sample", "suffix", "sep", *LAYOUT), *LAYOUT)


STOPS = ", ".join(map(str, [*ENDS, 50000]))


@query(
    "obj13_short_samples",
    f"""WITH {SAMPLES}, sized AS (SELECT sample, batch, tokens[2 :] AS t, n - 1 AS n, (32 + {h_below(223, "cut-size", "batch")})::INTEGER AS size FROM samples),
    tries AS (SELECT *, unnest(range(255 // size)) AS k FROM sized),
    drawn AS (SELECT *, {h_below("greatest(n - size, 1)", "cut-start", "sample", "k")} AS d FROM tries),
    started AS (SELECT *, list_max(list_filter(range(d + 1), lambda s: s = 0 OR (t[s + 1] <> 50000 AND t[s] IN ({STOPS})))) AS s FROM drawn),
    ended AS (SELECT *, coalesce(list_max(list_filter(range(s + 1, s + size + 1), lambda e: t[e] IN ({STOPS}))), s) AS e0 FROM started),
    final AS (SELECT *, CASE WHEN e0 - s < size // 2 THEN s + size ELSE e0 END AS e FROM ended)
    SELECT sample, batch, k::INTEGER AS piece, {joined("[50002] || CASE WHEN size >= n THEN t ELSE t[s + 1 : e] END")} AS tokens FROM final""",
)
def _(t):
    df = B.short_samples(_samples(t), "sample", "batch", SP, ENDS, SAMPLE + 1, "cut")
    return _show(df.select("sample", "batch", "piece", "tokens"), "tokens")


@query(
    "obj14_encoder_decoder",
    f"""WITH {SPANNED} SELECT sample, {joined(SOURCE)} AS source, {joined("flatten(list_transform(ks, lambda k: [50006] || tokens[k * 10 + 5 : k * 10 + 7])) || [50007]")} AS target FROM spanned""",
)
def _(t):
    return _show(B.encoder_decoder_layout(_with_spans(_samples(t)), SP).select("sample", "source", "target"), "source", "target")


@query(
    "obj15_masked_pair",
    f"""WITH {SAMPLES}, pairs AS (SELECT sample, tokens[2 : 1 + n // 2] AS a, tokens[2 + n // 2 :] AS b FROM samples WHERE n >= 4),
    seqs AS (SELECT sample, [50002] || a || [50001] || b || [50001] AS t, len(a) AS la, len(b) AS lb FROM pairs),
    wanted AS (SELECT *, least(20, greatest(1, round_even(len(t) * 0.15::DOUBLE, 0)::INTEGER), la + lb) AS k, list_filter(range(len(t)), lambda i: i <> 0 AND i <> la + 1 AND i <> la + lb + 2) AS cand FROM seqs),
    picked AS (SELECT *, list_transform(list_sort(list_transform(cand, lambda i: ('0x' || substr({h_hex("mlm", "sample", "i // 4")}, (8 * (i % 4) + 1)::INT, 8))::BIGINT * 16777216 + i))[1 : k], lambda x: x % 16777216) AS ps FROM wanted),
    flags AS (SELECT *, list_transform(range(len(t)), lambda i: list_contains(ps, i)) AS m FROM picked)
    SELECT sample, {joined("list_transform(t, lambda x, i: CASE WHEN NOT m[i] THEN x WHEN " + h_uniform("mlm-kind", "sample", "i - 1") + " < 0.8 THEN 50003 WHEN "
      + h_uniform("mlm-kind", "sample", "i - 1") + " < 0.9 THEN x ELSE " + h_below(256, "mlm-word", "sample", "i - 1") + " END) || list_resize([]::BIGINT[], 300 - len(t), 50000)")} AS text,
      {joined("list_transform(t, lambda x, i: CASE WHEN m[i] THEN x ELSE -1 END) || list_resize([]::BIGINT[], 300 - len(t), -1)")} AS mask_labels FROM flags""",
)
def _(t):
    half = F.floor(F.size("tokens") / 2)
    pairs = _samples(t).filter(F.size("tokens") >= 4).select("sample", A.take(F.col("tokens"), 1, half).alias("tokens_a"), A.drop(F.col("tokens"), half + 1).alias("tokens_b"))
    df = B.masked_pair(pairs, "sample", SP, 256, 300, "mlm", max_predictions=20)
    return _show(df.select("sample", "text", "mask_labels"), "text", "mask_labels")


@query(
    "obj16_word_blanks",
    f"""WITH w AS (SELECT doc_id, {words("text")} AS ws FROM documents),
    flat AS (SELECT doc_id, len(ws) AS n, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM w),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {h_hex("wb", "doc_id", "i")}) <= floor(n * 0.2::DOUBLE) AS m FROM flat),
    runs AS (SELECT *, m AND NOT coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM ranked),
    grouped AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
    src AS (SELECT doc_id, string_agg(CASE WHEN m THEN ' [MASK]' ELSE ' ' || w END, '' ORDER BY i) FILTER (WHERE NOT m OR opens) AS source FROM grouped GROUP BY doc_id),
    tgt AS (SELECT doc_id, run, string_agg(' ' || w, '' ORDER BY i) AS target FROM grouped WHERE m GROUP BY doc_id, run),
    tgts AS (SELECT doc_id, string_agg(target, '|' ORDER BY run) AS targets FROM tgt GROUP BY doc_id)
    SELECT doc_id, source, coalesce(targets, '') AS targets FROM src LEFT JOIN tgts USING (doc_id)""",
)
def _(t):
    df = B.word_blanks(t.documents.select("doc_id", "text"), "doc_id", T.split_words(F.col("text")), 0.2, "wb")
    return df.select("doc_id", "source", F.array_join("targets", "|").alias("targets"))


PIECES = f"""{SPANNED}, blanked AS (SELECT sample, {SOURCE} AS source, list_transform(ks, lambda k: tokens[k * 10 + 5 : k * 10 + 7]) AS pieces FROM spanned)"""


def _blanked(t):
    df = _with_spans(_samples(t))
    pieces = F.transform("spans", lambda s: A.take(F.col("tokens"), s["start"], s["end"] - s["start"]))
    return B.encoder_decoder_layout(df.withColumn("pieces", pieces), SP).select("sample", F.col("source").alias("tokens"), "pieces")


@query(
    "obj17_multi_blank_layout",
    f"""WITH {PIECES}, fitted AS (SELECT sample, pieces, list_resize(source, 160, 50000) AS s FROM blanked),
    marks AS (SELECT *, list_filter(range(160), lambda i: s[i + 1] = 50003) AS mk FROM fitted)
    SELECT sample, {joined("list_resize(s || flatten(list_transform(mk, lambda p, k: [50006] || pieces[k])), 240, 50000)")} AS text,
      {joined("list_resize(list_transform(s, lambda x: 0) || flatten(list_transform(mk, lambda p, k: pieces[k] || [50007])), 240, 50000)")} AS target,
      {joined("list_resize(list_transform(s, lambda x: 0) || flatten(list_transform(mk, lambda p, k: [1, 1, 1, 1])), 240, 0)")} AS loss_mask,
      {joined("list_resize(range(160) || flatten(list_transform(mk, lambda p: [p, p, p, p])), 240, 0)")} AS position,
      {joined("list_resize(list_transform(s, lambda x: 0) || flatten(list_transform(mk, lambda p: [1, 2, 3, 4])), 240, 0)")} AS block_position FROM marks""",
)
def _(t):
    df = B.multi_blank_layout(_blanked(t), SP, 160, 240)
    return _show(df.select("sample", *LAYOUT), *LAYOUT)


@query("obj18_fill_blanks", f"WITH {SAMPLES} SELECT sample, {joined('tokens')} AS tokens FROM samples")
def _(t):
    # Blank a sample, lay its pieces out as a generator would return them, and fill them in again: the sample comes back.
    # Here pad gets an id of its own, because samples hold eos, which usually shares its id.
    special = replace(SP, pad=-1)
    one = lambda x: F.array(F.lit(x))
    generated = F.flatten(F.transform("pieces", lambda p, k: F.concat(F.when(k == 0, F.array().cast("array<int>")).otherwise(one(SP.sop)), p, one(SP.eop))))
    filled = B.fill_blanks(F.concat(F.col("tokens"), one(-1)), generated, special)
    return _show(_blanked(t).select("sample", filled.alias("tokens")), "tokens")


@query(
    "win05_pad_to_batch_longest",
    f"WITH {SAMPLES} SELECT sample, {joined('list_resize(tokens, max(n) OVER (PARTITION BY batch), 50000)')} AS tokens FROM samples",
)
def _(t):
    return _show(pad_batch(_samples(t), "batch", "tokens", SP.pad).select("sample", "tokens"), "tokens")
