"""Prompts of every task rendered over `documents`, truncation, answers and label words."""

from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions import text as T
from tokenmill.operators import prompts as P
from tokenmill.operators import vocab as V
from tokenmill.operators.seq2seq import source_tokens
from tokenmill.operators.special import special_tokens
from tokenmill.operators.vocab import encode_chars
from tokenmill.plans.registry import query
from tokenmill.plans.sequences import _show
from tokenmill.plans.sqltext import codes, joined, words
from tokenmill.plans.tasks import word_spans
from tokenmill.plans.vocab import TOP_SQL, VOCAB_SIZE, _vocab

SP = special_tokens()

# Examples: the whole text behind its source, and its first line, with every meta field any task asks for.
EXAMPLES = f"""ex AS (SELECT doc_id AS guid, 'Source: ' || source || '. ' || text AS text_a, string_split(text, chr(10))[1] AS text_b, lang, source, doc_id,
  lang || ' ' || source || '.' AS choice1, string_split(text, chr(10))[1] AS choice2, {words("'Source: ' || source || '. ' || text")} AS ws FROM documents)"""


def _examples(t, text_b=None):
    line = F.split("text", "\n")[0]
    text = F.concat(F.lit("Source: "), "source", F.lit(". "), "text")
    ws = T.split_words(F.col("text"))
    meta = F.struct(
        F.concat("lang", F.lit(" "), "source", F.lit(".")).alias("choice1"), line.alias("choice2"),
        F.when(F.col("doc_id") % 2 == 0, "cause").otherwise("effect").alias("question"),
        F.col("lang").alias("word"), F.col("source").alias("answer"),
        F.substring(text, 1, 3).alias("span1_text"), F.lit(0).alias("span1_index"), F.lit(3).alias("span1_length"),
        F.substring(text, 11, 2).alias("span2_text"), F.lit(1).alias("span2_index"), F.lit(2).alias("span2_length"),
        ws.alias("candidates"), ws.alias("choices"),
    )
    return t.documents.select(
        F.col("doc_id").alias("guid"), text.alias("text_a"), (line if text_b is None else text_b(line)).alias("text_b"), "lang", "source", "doc_id", meta.alias("meta"))


def _examples_by_character(t):
    """The text has single spaces; the target and the pronoun are two of its words."""
    df = _examples(t).withColumn("w", T.split_words(F.col("text_a"))).withColumn("text_a", F.array_join("w", " "))
    spans = word_spans("w", F.col("doc_id"))
    meta = F.col("meta").withField("span1_length", F.length(spans["span1_text"])).withField("span2_length", F.length(spans["span2_text"]))
    for name in ("span1_text", "span1_index", "span2_text", "span2_index"):
        meta = meta.withField(name, spans[name])
    return df.withColumn("meta", meta).drop("w")


BARE = "regexp_replace({}, '[[:punct:]]+$', '')"
LOWER = "(lower(substr({0}, 1, 1)) || substr({0}, 2))"
BARE_LOWER = BARE.format(LOWER)
RSTRIP = "rtrim({}, ' ' || chr(10))"
QUESTION = BARE.format(RSTRIP.format("text_b"))
MARKED = "array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = 2 THEN '*' || w || '*' ELSE w END), ' ')"
PRONOUN = "substr(text_a, 11, 2)"
SPAN_1, SPAN_2 = "(doc_id % len(ws) + 1)", "((7 * doc_id + 3) % len(ws) + 1)"
# SQL of every template field, by task.
FIELDS_SQL = {
    "copa": {
        "premise": BARE.format("(' ' || text_a)"), "choice1": BARE_LOWER.format("choice1"), "choice2": BARE_LOWER.format("choice2"),
        "spaced2": "' ' || " + BARE_LOWER.format("choice2"), "joiner": "CASE WHEN doc_id % 2 = 0 THEN ' because' ELSE ', so' END",
    },
    "wsc": {
        "text": MARKED, "refers": f"' The pronoun ''*' || {PRONOUN} || '*'' refers to'",
        "previous": f"' In the previous sentence, the pronoun ''*' || {PRONOUN} || '*'' refers to'",
        "asks": f"' Question: In the passage above, what does the pronoun ''*' || {PRONOUN} || '*'' refer to?'",
    },
    "record": {"a": "text_a", "left": "' ' || rtrim(string_split(text_b, '@placeholder')[1], ' ')", "right": "string_split(text_b, '@placeholder')[2]"},
    "race": {"a": "text_a", "question": "' ' || text_b"},
    "race-blank": {
        "a": "text_a", "left": "rtrim(' ' || split_part(text_b, '_', 1), ' ')",
        "lower_left": LOWER.format("rtrim(' ' || split_part(text_b, '_', 1), ' ')"), "right": "substr(text_b, instr(text_b, '_') + 1)",
    },
    "rte": {"a": "text_a", "spaced_a": "' ' || text_a", "b": BARE.format("text_b"), "spaced_b": "' ' || " + BARE.format("text_b"), "full_b": "' ' || text_b"},
    "boolq": {"a": "text_a", "spaced_a": "' ' || text_a", "spaced_b": "' ' || text_b"},
    "multirc": {
        "passage": BARE.format(RSTRIP.format("text_a")), "question": f"' ' || {QUESTION}", "asked": f"' ' || {QUESTION} || '?'", "answer": "source", "spaced_answer": "' ' || source",
    },
    "wic": {
        "a": "text_a", "b": "text_b", "spaced_b": "' ' || text_b", "word": "lang", "both": "'\"' || text_a || '\" / \"' || text_b || '\"'",
        "sense": "' Similar sense of \"' || lang || '\"?'", "does": "' Does ' || lang || ' have the same meaning in both sentences?'",
    },
    "plain": {"a": "text_a", "b": "text_b"},
    "mnli": {"a": BARE.format("text_a"), "b": "text_b"},
    "mrpc": {"a": "text_a", "lower_b": LOWER.format("text_b"), "bare_b": BARE_LOWER.format("text_b")},
    "qnli": {"b": "text_b", "spaced_b": "' ' || text_b", "question": "' ' || " + BARE.format("text_a")},
    "squad": {"a": "text_a", "question": "' ' || text_b"},
    "cluewsc": {
        "text": f"array_to_string(list_transform(ws, lambda w, k: CASE WHEN k = {SPAN_1} THEN '#' ELSE '' END || CASE WHEN k = {SPAN_2} THEN '*' || w || '*' ELSE w END || CASE WHEN k = {SPAN_1} THEN '#' ELSE '' END), ' ')",
        "pronoun": f"'代词''*' || ws[{SPAN_2}] || '*'''", "is": f"'指#' || ws[{SPAN_1}] || '#.'", "is_quoted": f"'指''#' || ws[{SPAN_1}] || '#''.'",
    },
    "qa-cn": {"a": "text_a", "told": "'根据以下信息：' || text_a", "asked": "'请问，' || text_b"},
}
# The pronoun is the second word (wsc) or any word (cluewsc).
FIELDS_SQL["cb"] = FIELDS_SQL["rte"]
FIELDS_SQL["qqp"] = FIELDS_SQL["mrpc"]
for _name in ("agnews", "yahoo", "tnews", "afqmc", "yelp-polarity", "yelp-full", "xstance", "sst2", "cola"):
    FIELDS_SQL[_name] = FIELDS_SQL["plain"]


def _side_sql(task, template, side):
    terms = []
    for part_side, kind, value, _ in P.parts_of(template):
        if part_side == side and kind != "slot":
            terms.append({"mask": "'[MASK]'", "text": "'" + value.replace("'", "''") + "'"}.get(kind) or f"({FIELDS_SQL[task][value]})")
    return " || ".join(terms) or "''"


def _words_sql(task, pattern_id, label):
    words_of = P.PROMPTS[task].words.get(pattern_id, {})
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words_of.items())
    return f"CASE {label} {cases} END" if words_of else "NULL::VARCHAR"


def _register(number, task, text_b=None, where="", text_b_sql=None):
    """All patterns of a task: both sides as text, and the label word of a label picked by the document id."""
    prompt = P.PROMPTS[task]
    labels = sorted({label for by_label in prompt.words.values() for label in by_label})
    label_sql = "(" + ("[" + ", ".join(f"'{x}'" for x in labels) + f"])[(doc_id % {len(labels)} + 1)::INT]" if labels else "NULL::VARCHAR)")
    guarded = P.PROMPTS.get(prompt.guarded)

    def side(i, s):
        usual = _side_sql(task, prompt.patterns[i], s)
        if not guarded:
            return usual
        return f"CASE WHEN contains(text_b, '_') THEN {_side_sql(prompt.guarded, guarded.patterns[i], s)} ELSE {usual} END"

    base = EXAMPLES if text_b_sql is None else EXAMPLES.replace("string_split(text, chr(10))[1] AS text_b", f"{text_b_sql} AS text_b")
    sql = f"WITH {base} " + " UNION ALL ".join(
        f"SELECT guid, {i} AS pattern_id, {side(i, 'a')} AS side_a, {side(i, 'b')} AS side_b, {_words_sql(task, i, label_sql)} AS label_word FROM ex" for i in sorted(prompt.patterns))

    @query(f"prm{number:02d}_{task.replace('-', '_')}", sql)
    def plan(t):
        picked = F.element_at(F.array(*map(F.lit, labels)), (F.col("doc_id") % len(labels) + 1).cast("int")) if labels else F.lit(None).cast("string")
        examples = (_examples_by_character(t) if task == "cluewsc" else _examples(t, text_b)).withColumn("label", picked)
        df = P.render(examples, task, keep=["guid", "label"])
        return df.select(
            "guid", "pattern_id", P.side_text(F.col("parts"), "a").alias("side_a"), P.side_text(F.col("parts"), "b").alias("side_b"),
            P.verbalize(task, F.col("pattern_id"), F.col("label")).alias("label_word"))


_register(8, "copa")
_register(9, "wsc")
_register(10, "record", lambda line: F.concat(line, F.lit(" @placeholder. "), F.col("lang")), text_b_sql="string_split(text, chr(10))[1] || ' @placeholder. ' || lang")
_register(
    11, "race", lambda line: F.when(F.col("doc_id") % 2 == 0, F.concat(line, F.lit("  _ "), F.col("lang"))).otherwise(line),
    text_b_sql="CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10))[1] || '  _ ' || lang ELSE string_split(text, chr(10))[1] END",
)
for _number, _task in [
    (12, "rte"), (13, "cb"), (14, "boolq"), (15, "multirc"), (16, "wic"), (17, "agnews"), (18, "yahoo"), (19, "mnli"), (20, "tnews"), (21, "afqmc"), (22, "yelp-polarity"),
    (23, "yelp-full"), (24, "xstance"), (25, "sst2"), (26, "cola"), (27, "mrpc"), (28, "qqp"), (29, "qnli"), (30, "squad"), (31, "cluewsc"), (32, "qa-cn"),
]:
    _register(_number, _task)


@query("tsk35_pattern_ensemble", f"WITH {EXAMPLES} SELECT guid, i::INTEGER AS pattern_id, length(text_a)::BIGINT AS n FROM ex, range(5) r(i)")
def _(t):
    df = P.render(_examples(t).withColumn("n", F.length("text_a").cast("bigint")), "rte", keep=["guid", "n"])
    return df.select("guid", "pattern_id", "n")


@query(
    "prm01_learned_slots",
    """SELECT doc_id AS guid, i::INTEGER AS pattern_id, 6 AS first_slot, 4 AS second_slot, (10 + 2) AS total FROM documents, range(5) r(i)""",
)
def _(t):
    # A prefix of two learned tokens, and ten more over the slots of each pattern.
    df = P.render(_examples(t), "rte", learned=10, prefix=2)
    sizes = F.filter(F.transform("parts", lambda p: p["slot"]), lambda n: n > 0)
    return df.select(
        "guid", "pattern_id", (sizes[0] + sizes[1]).alias("first_slot"), F.get(sizes, F.lit(2)).alias("second_slot"),
        F.aggregate(sizes, F.lit(0), lambda acc, n: acc + n).alias("total"))


def _rte_tokens(t):
    df = P.render(_examples(t), "rte", [0])
    return df.withColumn("parts", P.encode_parts(F.col("parts"), encode_chars, SP.mask, SP.unk))


RTE0 = f"""{EXAMPLES}, enc AS (SELECT guid, {codes(BARE.format("text_b"))} AS b, {codes("text_a")} AS a FROM ex),
sized AS (SELECT *, greatest(len(a) + len(b) + 9 + 3 - 256, 0) AS k, least(greatest(len(a) + len(b) + 9 + 3 - 256, 0), abs(len(a) - len(b))) AS d FROM enc),
losses AS (SELECT *, CASE WHEN len(b) > len(a) THEN d ELSE 0 END + (k - d) // 2 AS lb FROM sized),
cut AS (SELECT *, [34] || b[1 : len(b) - lb] || [34, 32, 63] AS sa, [50003, 44, 32, 34] || a[1 : len(a) - (k - lb)] || [34] AS sb FROM losses)"""


@query(
    "prm02_truncation",
    f"WITH {RTE0} SELECT guid, k::INTEGER AS removed, k > len(a) + len(b) AS overflow, {joined('sa')} AS tokens_a, {joined('sb')} AS tokens_b FROM cut",
)
def _(t):
    df = P.truncate_parts(_rte_tokens(t), "parts", F.lit(0), 256)
    df = df.select("guid", F.col("removed").cast("int").alias("removed"), "overflow", P.side_tokens(F.col("parts"), "a").alias("tokens_a"), P.side_tokens(F.col("parts"), "b").alias("tokens_b"))
    return _show(df, "tokens_a", "tokens_b")


@query(
    "prm03_answer_segments",
    f"""WITH {EXAMPLES}, enc AS (SELECT guid, {codes("' ' || choice2")} || [50007] AS ans, {codes("choice1")} || [50003] || [46] AS prompt FROM ex),
    segs AS (SELECT *, unnest(range((len(ans) + 127) // 128)) AS s FROM enc)
    SELECT guid, s::INTEGER AS segment, {joined("ans[s * 128 + 1 : s * 128 + 128]")} AS target, {joined("prompt[1 : len(prompt) - 2] || ans[1 : s * 128] || prompt[len(prompt) - 1 :]")} AS prompt FROM segs""",
)
def _(t):
    df = _examples(t).select("guid", encode_chars(F.concat(F.lit(" "), "meta.choice2")).alias("answer"), F.concat(encode_chars(F.col("meta.choice1")), F.array(F.lit(SP.mask), F.lit(46))).alias("prompt"))
    df = P.answer_segments(df, ["guid", "prompt"], "answer", SP.eop, 128)
    return _show(df.select("guid", "segment", "target", P.splice_before(F.col("prompt"), SP.mask, F.col("spliced")).alias("prompt")), "target", "prompt")


@query(
    "prm04_label_word_violations",
    f"""WITH {TOP_SQL}, words AS (SELECT * FROM (VALUES {", ".join(f"('rte', {i}, '{label}', '{answer}')" for i, by in sorted(P.PROMPTS["rte"].words.items()) for label, answer in by.items())}) AS v(task, pattern_id, label, answer))
    SELECT task, pattern_id, label, answer FROM words WHERE trim(answer) NOT IN (SELECT token FROM vocab)""",
)
def _(t):
    return P.single_token_violations(P.verbalizer_table(t.spark, "rte"), F.broadcast(V.assemble_vocab(_vocab(t), VOCAB_SIZE)))


@query(
    "prm05_verbalizer_file",
    f"""WITH f AS (SELECT doc_id, [(doc_id % 4)::VARCHAR, lang || ' ' || source, '', (doc_id % 3 + 4)::VARCHAR] || list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\\s') AND {words("l")}[1] IS NOT NULL AND NOT regexp_matches(l, '^[0-9]+$')) AS ls FROM documents),
    lines AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS value FROM f)
    SELECT doc_id, (CASE WHEN line_no < 3 THEN doc_id % 4 ELSE doc_id % 3 + 4 END)::INTEGER AS pattern_id, line_no, {words("value")}[1] AS label, array_to_string({words("value")}[2:], ' ') AS words
    FROM lines WHERE line_no NOT IN (0, 2, 3)""",
)
def _(t):
    head = F.array((F.col("doc_id") % 4).cast("string"), F.concat_ws(" ", "lang", "source"), F.lit(""), (F.col("doc_id") % 3 + 4).cast("string"))
    body = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\s") & F.get(T.split_words(x), F.lit(0)).isNotNull() & ~x.rlike(r"^\d+$"))
    lines = t.documents.select("doc_id", F.posexplode(F.concat(head, body)).alias("line_no", "value"))
    return P.parse_verbalizer(lines, "doc_id", "line_no", "value").select("doc_id", "pattern_id", "line_no", "label", F.array_join("words", " ").alias("words"))


@query(
    "prm06_labelled_priming",
    f"""WITH {RTE0} SELECT guid, {joined("[50002] || sa || [32, 78, 111] || sb[2 :] || [50000]")} AS tokens FROM cut""",
)
def _(t):
    df = P.truncate_parts(_rte_tokens(t), "parts", F.lit(0), 256)
    whole = F.concat(P.side_tokens(F.col("parts"), "a"), P.side_tokens(F.col("parts"), "b"))
    filled = P.fill_mask(whole, SP.mask, encode_chars(F.lit(" No")))
    return _show(df.select("guid", F.concat(F.array(F.lit(SP.cls)), filled, F.array(F.lit(SP.eos))).alias("tokens")), "tokens")


@query("prm35_mask_labels", f"WITH {RTE0} SELECT guid, {joined('list_transform(sa || sb, lambda x, i: CASE WHEN i = len(sa) + 1 THEN 1 ELSE -1 END)')} AS labels FROM cut")
def _(t):
    df = P.truncate_parts(_rte_tokens(t), "parts", F.lit(0), 256)
    whole = F.concat(P.side_tokens(F.col("parts"), "a"), P.side_tokens(F.col("parts"), "b"))
    return _show(df.select("guid", P.mask_labels(whole, SP.mask).alias("labels")), "labels")


@query(
    "prm07_string_helpers",
    f"SELECT doc_id, {BARE.format('text')} AS bare, {LOWER.format('text')} AS lowered, upper(substr(text, 1, 1)) || substr(text, 2) AS raised FROM documents",
)
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", T.strip_final_punctuation(text).alias("bare"), T.lower_first(text).alias("lowered"), T.upper_first(text).alias("raised"))


@query(
    "prm08_copa_connective",
    f"""WITH {EXAMPLES}, c AS (SELECT *, {BARE_LOWER.format("choice1")} AS c1, {BARE_LOWER.format("choice2")} AS c2 FROM ex)
    SELECT guid, k::INTEGER AS choice_no, '"' || c1 || '" or "' || c2 || '"?' || {BARE.format("text_a")} || '[MASK] ' || CASE k WHEN 0 THEN c1 ELSE c2 END AS text,
      CASE WHEN doc_id % 2 = 0 THEN ' because' ELSE ' so' END AS answer FROM c, range(2) r(k)""",
)
def _(t):
    answers = P.PROMPTS["copa"].answers()
    answer = F.when(F.col("meta.question") == "cause", P.COPA_CONNECTIVE_WORDS["cause"]).otherwise(P.COPA_CONNECTIVE_WORDS["effect"])
    rows = _examples(t).select("*", F.posexplode(answers).alias("choice_no", "choice"))
    fields = {**P.PROMPTS["copa"].fields(), "choice": F.col("choice")}
    text = P.side_text(P.part_column(P.COPA_CONNECTIVE, fields), "a")
    return rows.select("guid", "choice_no", text.alias("text"), answer.alias("answer"))


@query(
    "prm33_summary_source",
    f"""WITH s AS (SELECT doc_id, {codes("' ' || text")} AS src FROM documents) SELECT doc_id, {joined("list_resize([50002, 50003] || " + codes("' Content:'") + " || src[1 : 608 - 11], 608, 50000)")} AS source FROM s""",
)
def _(t):
    df = t.documents.select("doc_id", F.col("text").alias("text_a"))
    return _show(df.select("doc_id", A.pad(source_tokens("cnn_dm", encode_chars, SP, 608), 608, SP.pad).alias("source")), "source")


@query(
    "prm33_question_source",
    f"""WITH s AS (SELECT doc_id, {codes("' ' || rtrim(text, ' ' || chr(10))")} AS src, {codes("' ' || source")} AS q FROM documents)
    SELECT doc_id, {joined("[50002] || q || [50003, 46] || src[1 : 300 - len(q) - 3]")} AS source FROM s""",
)
def _(t):
    df = t.documents.select("doc_id", F.col("text").alias("text_a"), F.struct(F.col("source").alias("question")).alias("meta"))
    return _show(df.select("doc_id", source_tokens("squad", encode_chars, SP, 300).alias("source")), "source")


@query(
    "prm33_answer_source",
    f"""WITH s AS (SELECT doc_id, rtrim(text, ' ' || chr(10)) || ' Question:' AS source, {words("text")}[3] AS w FROM documents WHERE len({words("text")}) >= 3),
    enc AS (SELECT doc_id, {codes("source")} AS src, {codes("' Answer: ' || w")} AS ans, instr(source, ' ' || w) - 1 AS hit FROM s),
    room AS (SELECT *, 300 - len(ans) - 2 AS room, CASE WHEN hit < 0 THEN 0 ELSE greatest(hit - (300 - len(ans) - 2) // 2, 0) END AS start FROM enc)
    SELECT doc_id, {joined("[50002] || CASE WHEN len(src) > room THEN src[start + 1 : start + room] ELSE src END || [50003] || ans")} AS source FROM room""",
)
def _(t):
    ws = T.split_words(F.col("text"))
    df = t.documents.filter(F.size(ws) >= 3).select("doc_id", F.col("text").alias("text_a"), F.struct(ws[2].alias("answer")).alias("meta"))
    return _show(df.select("doc_id", source_tokens("squad_generation", encode_chars, SP, 300).alias("source")), "source")


@query(
    "prm34_interactive_context",
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' of ', ' [MASK] ') ELSE text END AS text FROM documents),
    g AS (SELECT doc_id, CASE WHEN contains(text, 'MASK]') THEN text ELSE text || ' [gMASK]' END AS text FROM m)
    SELECT doc_id, '[CLS]' || text || CASE WHEN ends_with(text, '[gMASK]') THEN '' ELSE '<|endoftext|>' END AS text FROM g""",
)
def _(t):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit(" of "), F.lit(" [MASK] "))).otherwise(F.col("text"))
    return t.documents.select("doc_id", P.interactive_context(text).alias("text"))
