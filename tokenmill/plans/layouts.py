"""Fixed-width model inputs built from character ids of `documents`: the text is one side, its first line the other."""

from pyspark.sql import functions as F

from tokenmill.functions import text as T
from tokenmill.operators import layout as L
from tokenmill.operators.examples import cause_and_effect, cause_and_effect_layout_text
from tokenmill.operators.special import special_tokens
from tokenmill.operators.vocab import encode_chars
from tokenmill.plans.blanks import SAMPLES, _samples
from tokenmill.plans.registry import query
from tokenmill.plans.sequences import _show
from tokenmill.plans.sqltext import codes, joined, words
from tokenmill.plans.tasks import BASE, _base, _copa

SP = special_tokens()
WIDTH = 200
INPUTS = ("ids", "types", "padding_mask", "position", "block_position", "target", "logit_mask")

# a is the source name and a mask, b the text (absent in every fourth document), the answer is the language.
ENC = f"""raw AS (SELECT doc_id, {codes("source")} || [50003] AS a, CASE WHEN doc_id % 4 > 0 THEN {codes("text")} END AS b, {codes("lang")} || [50007] AS ans FROM documents)"""


def _enc(t):
    return t.documents.select(
        "doc_id",
        F.concat(encode_chars(F.col("source")), F.array(F.lit(SP.mask))).alias("tokens_a"),
        F.when(F.col("doc_id") % 4 > 0, encode_chars(F.col("text"))).alias("tokens_b"),
        F.concat(encode_chars(F.col("lang")), F.array(F.lit(SP.eop))).alias("answer"),
    )


def _input_sql(sep, answer):
    """The layout for a, b and optionally the answer."""
    parts = "[50002] || a" + (" || CASE WHEN b IS NULL THEN [] ELSE [50001] END" if sep else "") + " || coalesce(b, [])"
    lead = "1 + len(a)" + (" + (b IS NOT NULL)::INT" if sep else "")
    n = "len(ans)" if answer else "1"
    shown = "[50006] || ans[1 : len(ans) - 1]" if answer else "[50006]"
    target = "ans" if answer else "[0]"
    pad = lambda x, v: joined(f"list_resize({x}, {WIDTH}, {v})")
    return f"""WITH {ENC}, whole AS (SELECT *, {parts} AS c0, {lead} AS lead FROM raw),
    capped AS (SELECT *, CASE WHEN len(c0) >= {WIDTH} - 1 THEN c0[1 : {WIDTH} - 1] ELSE c0 END AS c1 FROM whole),
    ended AS (SELECT *, c1 || [50000] AS c, (b IS NOT NULL)::INT AS e FROM capped),
    placed AS (SELECT *, len(c) AS sep, list_max(list_filter(range(len(c)), lambda i: c[i + 1] = 50003)) AS spot, greatest({WIDTH}, len(c) + {n}) AS w FROM ended)
    SELECT doc_id, sep::INTEGER AS sep, {joined(f"list_resize(c || {shown}, w, 50000)")} AS ids,
      {joined(f"list_resize(list_transform(range(len(c1)), lambda i: CASE WHEN i < lead THEN 0 ELSE 1 END) || [e] || list_transform(range({n}), lambda i: e), w, 50000)")} AS types,
      {joined(f"list_resize(list_transform(range(sep + {n}), lambda i: 1), w, 0)")} AS padding_mask,
      {joined(f"list_resize(range(sep) || list_transform(range({n}), lambda i: spot), w, 0)")} AS position,
      {joined(f"list_resize(list_transform(range(sep), lambda i: 0) || range(1, {n} + 1), w, 0)")} AS block_position,
      {joined(f"list_resize(list_transform(range(sep), lambda i: 0) || {target}, w, 0)")} AS target,
      {joined(f"list_resize(list_transform(range(sep), lambda i: 0) || list_transform(range({n}), lambda i: 1), w, 0)")} AS logit_mask FROM placed"""


@query("lay01_input_with_answer", _input_sql(False, True))
def _(t):
    df = L.build_input(_enc(t), SP, WIDTH, answer="answer")
    return _show(df.select("doc_id", "sep", *INPUTS), *INPUTS)


@query("lay01_input_with_piece", _input_sql(True, False))
def _(t):
    df = L.build_input(_enc(t), SP, WIDTH, add_sep=True, add_piece=True)
    return _show(df.select("doc_id", "sep", *INPUTS), *INPUTS)


@query(
    "lay02_left_to_right",
    f"""WITH {ENC}, ids AS (SELECT *, [50002, 50003, 50006] || a || ans[1 : len(ans) - 1] AS c, greatest({WIDTH}, 2 + len(a) + len(ans)) AS w FROM raw)
    SELECT doc_id, 2 AS sep, {joined("list_resize(c, w, 50000)")} AS ids, {joined("list_resize([0, 1] || list_transform(range(len(c) - 2), lambda i: 1), w, 0)")} AS position,
      {joined("list_resize([0, 0] || range(1, len(c) - 1), w, 0)")} AS block_position, {joined("list_resize(list_transform(range(len(a) + 2), lambda i: 0) || ans, w, 0)")} AS target,
      {joined("list_resize(list_transform(range(len(a) + 2), lambda i: 0) || list_transform(ans, lambda x: 1), w, 0)")} AS logit_mask FROM ids""",
)
def _(t):
    wanted = ("ids", "position", "block_position", "target", "logit_mask")
    return _show(L.build_left_to_right(_enc(t), SP, WIDTH).select("doc_id", "sep", *wanted), *wanted)


@query(
    "lay03_decoder_input",
    f"""WITH {ENC} SELECT doc_id, {joined("list_resize([50006] || ans[1 : len(ans) - 1], 16, 50000)")} AS dec_ids, {joined("list_resize(list_transform(ans, lambda x: len(a) - 1), 16, 0)")} AS dec_position,
      {joined("list_resize(range(1, len(ans) + 1), 16, 0)")} AS dec_block_position, {joined("list_resize(ans, 16, 0)")} AS dec_target, {joined("list_resize(list_transform(ans, lambda x: 1), 16, 0)")} AS dec_logit_mask FROM raw""",
)
def _(t):
    wanted = ("dec_ids", "dec_position", "dec_block_position", "dec_target", "dec_logit_mask")
    return _show(L.build_decoder_input(_enc(t), SP, 16, encoded="tokens_a").select("doc_id", *wanted), *wanted)


@query(
    "lay04_special_budget",
    "SELECT doc_id, 2 + CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents",
)
def _(t):
    return t.documents.select("doc_id", L.special_budget(F.col("doc_id") % 4 > 0, F.col("doc_id") % 3 > 0, sep=True, piece=True).alias("n"))


@query(
    "lay05_padded_choices",
    f"""WITH ch AS (SELECT doc_id, doc_id // 8 AS batch, {words("text")} AS cs FROM documents WHERE len({words("text")}) > 0),
    w AS (SELECT *, max(len(cs)) OVER (PARTITION BY batch) AS w FROM ch)
    SELECT doc_id, batch, {joined("list_resize(cs, w, cs[1])")} AS choices, {joined("list_resize(list_transform(cs, lambda c: 1), w, 0)")} AS choice_mask FROM w""",
)
def _(t):
    df = t.documents.select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), T.split_words(F.col("text")).alias("choices")).filter(F.size("choices") > 0)
    return _show(L.pad_choices(df, "batch", "choices"), "choices", "choice_mask")


S2S = f"""raw AS (SELECT doc_id, [50002, 50003] || {codes("text")} AS src, {codes("string_split(text, chr(10))[1]")} AS tgt FROM documents),
fitted AS (SELECT doc_id, list_resize(src, 160, 50000) AS s, list_resize(tgt || [50007], 40, 50000) AS k, least(len(tgt) + 1, 40) AS n FROM raw)"""


def _s2s(t):
    source = F.concat(F.array(F.lit(SP.cls), F.lit(SP.mask)), encode_chars(F.col("text")))
    return t.documents.select("doc_id", source.alias("source"), encode_chars(F.split("text", "\n")[0]).alias("target"))


@query(
    "lay06_pair_for_training",
    f"""WITH {S2S} SELECT doc_id, 160 AS sep, {joined("s || [50006] || k[1 : 39]")} AS text, {joined("list_transform(s, lambda x: 0) || k")} AS target,
      {joined("list_transform(s, lambda x: 0) || list_resize(list_transform(range(n), lambda i: 1), 40, 0)")} AS loss_mask,
      {joined("range(160) || list_transform(k, lambda x: 1)")} AS position, {joined("list_transform(s, lambda x: 0) || range(1, 41)")} AS block_position FROM fitted""",
)
def _(t):
    wanted = ("text", "target", "loss_mask", "position", "block_position")
    return _show(L.sequence_pair_train(_s2s(t), SP, 160, 40).select("doc_id", "sep", *wanted), *wanted)


@query(
    "lay06_pair_for_generation",
    f"""WITH {S2S} SELECT doc_id, 160 AS sep, {joined("s || [50006]")} AS text, {joined("range(160) || [1]")} AS position, {joined("list_transform(s, lambda x: 0) || [1]")} AS block_position FROM fitted""",
)
def _(t):
    wanted = ("text", "position", "block_position")
    return _show(L.sequence_pair_eval(_s2s(t), SP, 160).select("doc_id", "sep", *wanted), *wanted)


@query(
    "lay07_shifted_labels",
    f"WITH {SAMPLES} SELECT sample, {joined('tokens[1 : n - 1]')} AS tokens, {joined('tokens[2 :]')} AS labels, {joined('list_transform(range(n - 1), lambda i: 1)')} AS loss_mask FROM samples",
)
def _(t):
    df = _samples(t).select("sample", L.shifted(F.col("tokens"), F.col("loss_mask")).alias("s")).select("sample", "s.*")
    return _show(df, "tokens", "labels", "loss_mask")


@query(
    "lay08_choice_pairs",
    f"""WITH {BASE}, c AS (SELECT 'dev-' || doc_id AS guid, [ls[1], rest] AS cs, (doc_id % 2)::VARCHAR AS label, {codes("text || CASE WHEN doc_id % 2 = 0 THEN ' because' ELSE ' so' END")} AS a FROM base),
    rows AS (SELECT guid, label, a, unnest(range(2))::INTEGER AS choice_no, unnest(list_transform(cs, lambda c: {codes("c")})) AS b FROM c),
    capped AS (SELECT *, [50002] || a || [50001] || b AS c FROM rows),
    ids AS (SELECT *, CASE WHEN len(c) >= 399 THEN c[1 : 399] ELSE c END || [50000] AS ids FROM capped)
    SELECT guid, choice_no, label, len(ids)::INTEGER AS sep, {joined("list_resize(ids, 400, 50000)")} AS ids,
      {joined("list_resize(list_transform(range(len(ids) - 1), lambda i: CASE WHEN i < len(a) + 2 THEN 0 ELSE 1 END) || [1], 400, 50000)")} AS types FROM ids""",
)
def _(t):
    df = cause_and_effect_layout_text(cause_and_effect(_copa(t), "dev"))
    df = df.select("guid", "choice_no", "label", encode_chars(F.col("text_a")).alias("tokens_a"), encode_chars(F.col("text_b")).alias("tokens_b"))
    return _show(L.build_input(df, SP, 400, add_sep=True).select("guid", "choice_no", "label", "sep", "ids", "types"), "ids", "types")


@query(
    "lay09_gold_choice",
    f"WITH {BASE} SELECT doc_id, (doc_id % 2)::INTEGER AS choice_no, CASE WHEN doc_id % 2 = 0 THEN ls[1] ELSE rest END AS choice FROM base",
)
def _(t):
    choices = F.array(F.get("ls", F.lit(0)), F.col("rest"))
    rows = _base(t).select("doc_id", (F.col("doc_id") % 2).alias("label"), F.posexplode(choices).alias("choice_no", "choice"))
    return L.gold_choice(rows).select("doc_id", "choice_no", "choice")


@query(
    "lay10_truncated_rows",
    "SELECT sum(CASE WHEN 3 + length(text) + length(source) > 512 THEN 1 ELSE 0 END)::BIGINT AS n_truncated, count(*) AS n_rows FROM documents",
)
def _(t):
    budget = L.special_budget(F.lit(True), F.lit(False), sep=True)
    return L.truncated_rows(t.documents, [F.length("text"), F.length("source")], budget, 512)
