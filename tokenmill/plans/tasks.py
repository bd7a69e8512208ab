"""Benchmark tables to examples. Raw rows in each task's shape are derived from `documents` (and `conversations`)."""

from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions import text as T
from tokenmill.operators import examples as E
from tokenmill.operators.vocab import encode_chars
from tokenmill.plans.registry import query
from tokenmill.plans.sequences import _show
from tokenmill.plans.sqltext import codes, h_below, joined, words

STD = "translate({}, '“”’‘–', '\"\"''''-')"
# The pieces of a document that stand for the fields of a benchmark row.
BASE = f"""base AS (SELECT *, string_split(text, chr(10)) AS ls, {words("text")} AS ws, substr(text, length(string_split(text, chr(10))[1]) + 2) AS rest,
  CASE WHEN doc_id % 5 > 0 THEN lang END AS tag FROM documents)"""

def _base(t):
    return t.documents.select(
        "*", F.split("text", "\n").alias("ls"), T.split_words(F.col("text")).alias("ws"), F.expr("substring(text, length(split(text, '\\n')[0]) + 2)").alias("rest"),
        F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("tag"))

def _line(i):
    return F.coalesce(F.get("ls", F.lit(i)), F.lit(""))

def _sql(guid, a, b="NULL::VARCHAR", label="NULL::VARCHAR", idx="'-1'", n="1", more="", tail="FROM base", std=True):
    form = STD if std else "{}"
    b = b if b.startswith("NULL") else form.format(b)
    return f"WITH {BASE} SELECT {guid} AS guid, {form.format(a)} AS text_a, {b} AS text_b, {label} AS label, {idx} AS idx, {n}::INTEGER AS num_choices{more} {tail}"

NUMBERED = "CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END || doc_id::VARCHAR"
IDX = "CASE WHEN doc_id % 4 = 0 THEN doc_id + 7 ELSE doc_id END"

def _pairs(t, first, second):
    idx = F.concat(F.when(F.col("doc_id") % 4 == 0, "x").otherwise(""), F.col("doc_id").cast("string"))
    return _base(t).select(idx.alias("idx"), (F.col("doc_id") + 7).alias("line_no"), F.col("text").alias(first), _line(0).alias(second), F.col("tag").alias("label"))

@query("tsk01_entailment", _sql(f"'train-' || ({IDX})::VARCHAR", "text", "ls[1]", "tag", f"({IDX})::VARCHAR"))
def _(t):
    return E.TASKS["rte"].build(_pairs(t, "premise", "hypothesis"), "train")

@query("tsk01_entailment_ax_b", _sql(f"'test-' || ({IDX})::VARCHAR", "text", "ls[1]", "tag", f"({IDX})::VARCHAR"))
def _(t):
    return E.TASKS["ax-b"].build(_pairs(t, "sentence1", "sentence2"), "test")

@query("tsk02_three_way_entailment", _sql(f"'dev-' || ({IDX})::VARCHAR", "text", "ls[1]", "coalesce(tag, 'entailment')", f"({IDX})::VARCHAR"))
def _(t):
    task = E.TASKS["cb"]
    return E.labelled_or_first(task.build(_pairs(t, "premise", "hypothesis"), "dev"), task.labels)

@query(
    "tsk03_word_in_context",
    _sql("'train-' || doc_id::VARCHAR", "lang || ': ' || text", "ls[1]", "CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END", "doc_id::VARCHAR", more=", lang AS word"),
)
def _(t):
    label = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, False)
    raw = _base(t).select(F.col("doc_id").cast("string").alias("idx"), F.col("lang").alias("word"), F.col("text").alias("sentence1"), _line(0).alias("sentence2"), label.alias("label"))
    return E.word_in_context_text(E.TASKS["wic"].build(raw, "train")).select("*", "meta.word").drop("meta")

# The first span is the third word, the pronoun the fifth; their indexes are off by -1, 0 or 1, and a third of the pronouns
# is only the start of its word. The candidates are all words behind it. Texts are compared by digest, since each has many rows.
WSC_BASE = f"""{BASE}, wsc AS (SELECT doc_id, text, ws, ws[3] AS s1, CASE WHEN doc_id % 3 = 0 THEN substr(ws[5], 1, 1) ELSE ws[5] END AS s2,
  (2 + doc_id % 3 - 1)::INTEGER AS i1, (4 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 3 - 1 END)::INTEGER AS i2, ws[6:] AS cands, CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS label FROM base WHERE len(ws) >= 8),
wsc1 AS (SELECT *, list_filter(cands, lambda c, i: list_position(cands, c) = i) AS names,
  list_transform(ws, lambda w: lower(w)) AS low FROM wsc),
shifted AS (SELECT *, CASE WHEN low[i1 + 1] = lower(s1) THEN i1 WHEN i1 >= 1 AND low[i1] = lower(s1) THEN i1 - 1 WHEN low[i1 + 2] = lower(s1) THEN i1 + 1 ELSE i1 END AS j1,
  CASE WHEN ws[i2 + 1] = s2 THEN i2 WHEN i2 >= 1 AND ws[i2] = s2 THEN i2 - 1 WHEN ws[i2 + 2] = s2 THEN i2 + 1 ELSE i2 END AS j2 FROM wsc1),
fixed AS (SELECT *, CASE WHEN ws[j2 + 1] <> s2 AND starts_with(ws[j2 + 1], s2) THEN ws[1 : j2] || [s2, substr(ws[j2 + 1], length(s2) + 1)] || ws[j2 + 2 :] ELSE ws END AS fw FROM shifted)"""

def _wsc(t):
    base = _base(t).filter(F.size("ws") >= 8)
    target = F.struct(
        F.col("ws")[2].alias("span1_text"),
        (F.lit(2) + (F.col("doc_id") % 3) - 1).cast("int").alias("span1_index"),
        F.when(F.col("doc_id") % 3 == 0, F.substring(F.col("ws")[4], 1, 1)).otherwise(F.col("ws")[4]).alias("span2_text"),
        (F.lit(4) + F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % 3 - 1)).cast("int").alias("span2_index"),
    )
    candidates = F.transform(A.drop(F.col("ws"), 5), lambda w: F.struct(w.alias("text")))
    return base.select(F.col("doc_id").alias("idx"), "text", target.alias("target"), candidates.alias("candidates"), (F.col("doc_id") % 2 == 0).alias("label"))

WSC_META = ", s1 AS span1_text, s2 AS span2_text, j1 AS span1_index, j2 AS span2_index, fw[j2 + 1] = s2 AS aligned"

def _flat(df):
    df = df.select("*", "meta.*").drop("meta")
    return df.withColumn("candidates", F.coalesce(F.array_join("candidates", "|"), F.lit("")))

@query(
    "tsk04_pronoun_choice_train",
    f"""WITH {WSC_BASE}, groups AS (SELECT *, unnest(range(CASE WHEN len(names) > 9 THEN (len(names) + 8) // 9 ELSE 1 END)) AS g FROM fixed WHERE label = 'True')
    SELECT 'train-' || doc_id::VARCHAR AS guid, md5(array_to_string(fw, ' ')) AS text_a, NULL::VARCHAR AS text_b, label, doc_id::VARCHAR AS idx, 1::INTEGER AS num_choices, g::INTEGER AS group_no,
      array_to_string(CASE WHEN len(names) > 9 THEN names[g * 9 + 1 : g * 9 + 9] || names[1 : 9 - len(names[g * 9 + 1 : g * 9 + 9])] ELSE names END, '|') AS candidates{WSC_META} FROM groups""",
)
def _(t):
    return _flat(E.TASKS["wsc"].build(_wsc(t), "train", carry=F.md5))

@query(
    "tsk04_pronoun_choice_dev",
    f"""WITH {WSC_BASE} SELECT 'dev-' || doc_id::VARCHAR AS guid, md5(array_to_string(fw, ' ')) AS text_a, NULL::VARCHAR AS text_b, label, doc_id::VARCHAR AS idx, 1::INTEGER AS num_choices,
      0 AS group_no, array_to_string(names, '|') AS candidates{WSC_META} FROM fixed""",
)
def _(t):
    return _flat(E.TASKS["wsc"].build(_wsc(t), "dev", carry=F.md5))

@query(
    "tsk04_pronoun_pairs",
    f"""WITH {WSC_BASE}, pairs AS (SELECT *, unnest([s1] || CASE WHEN label = 'True' THEN names ELSE []::VARCHAR[] END) AS b,
        unnest(range(CASE WHEN label = 'True' THEN len(names) + 1 ELSE 1 END)) AS k FROM fixed)
    SELECT 'train-' || doc_id::VARCHAR AS guid, md5(array_to_string(fw, ' ')) AS text_a, b AS text_b, CASE WHEN k = 0 THEN label ELSE 'False' END AS label, doc_id::VARCHAR AS idx, 1::INTEGER AS num_choices,
      '' AS candidates{WSC_META} FROM pairs""",
)
def _(t):
    return _flat(E.TASKS["wsc1"].build(_wsc(t), "train", carry=F.md5))

@query("tsk05_yes_no_question", _sql("'test-' || doc_id::VARCHAR", "text", "ls[1]", "CASE WHEN doc_id % 3 > 0 THEN (doc_id % 2 = 0)::VARCHAR END", "doc_id::VARCHAR"))
def _(t):
    label = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 2 == 0)
    return E.TASKS["boolq"].build(_base(t).select(F.col("doc_id").alias("idx"), F.col("text").alias("passage"), _line(0).alias("question"), label.alias("label")), "test")

def _copa(t):
    question = F.when(F.col("doc_id") % 2 == 0, "cause").otherwise("effect")
    return _base(t).select(
        F.col("doc_id").alias("idx"), F.col("text").alias("premise"), _line(0).alias("choice1"), F.col("rest").alias("choice2"), question.alias("question"), (F.col("doc_id") % 2).alias("label"))

@query(
    "tsk06_cause_and_effect",
    f"""WITH {BASE}, c AS (SELECT doc_id, text, ls[1] AS c1, rest AS c2, CASE WHEN doc_id % 2 = 0 THEN 'cause' ELSE 'effect' END AS question FROM base)
    SELECT 'train-' || doc_id::VARCHAR AS guid, text AS text_a, NULL::VARCHAR AS text_b, (doc_id % 2)::VARCHAR AS label, doc_id::VARCHAR AS idx, 1::INTEGER AS num_choices, c1 AS choice1, c2 AS choice2, question FROM c
    UNION ALL SELECT 'train-' || doc_id::VARCHAR || 'm', text, NULL, (1 - doc_id % 2)::VARCHAR, '-1', 1, c2, c1, question FROM c""",
)
def _(t):
    return E.TASKS["copa"].build(_copa(t), "train").select("*", "meta.*").drop("meta")

# A document is a passage, its lines are questions, and the words of a line are the answers.
QUESTIONS = f"""{BASE}, questions AS (SELECT doc_id, text, unnest(range(len(ls)))::INTEGER AS q, unnest(ls) AS question FROM base),
answers AS (SELECT *, {words("question")} AS aw FROM questions)"""

def _multirc(t):
    answers = lambda line: F.transform(T.split_words(line), lambda w, i: F.struct(i.alias("idx"), w.alias("text"), (F.length(w) % 2).alias("label")))
    questions = F.transform("ls", lambda line, i: F.struct(i.alias("idx"), line.alias("question"), answers(line).alias("answers")))
    return _base(t).select(F.col("doc_id").alias("idx"), F.struct("text", questions.alias("questions")).alias("passage"))

@query(
    "tsk07_answer_sentences",
    f"""WITH {QUESTIONS}, digests AS (SELECT doc_id, md5({STD.format("text")}) AS text_a FROM base),
    a AS (SELECT doc_id, q, question, unnest(range(len(aw)))::INTEGER AS k, unnest(aw) AS answer FROM answers)
    SELECT 'dev-p' || doc_id || '-q' || q || '-a' || k AS guid, text_a, {STD.format("question")} || ' answer: ' || {STD.format("answer")} AS text_b,
      (length(answer) % 2)::VARCHAR AS label, doc_id || ',' || q || ',' || k AS idx, 1::INTEGER AS num_choices FROM a JOIN digests USING (doc_id)""",
)
def _(t):
    return E.answer_sentences_text(E.TASKS["multirc"].build(_multirc(t), "dev", carry=F.md5)).drop("meta")

@query(
    "tsk08_reading_choice",
    f"""WITH {QUESTIONS} SELECT 'train-p' || doc_id || '-q' || q AS guid, md5(replace(replace(replace(regexp_replace(text, '\\s+', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. ')) AS text_a,
      question AS text_b, chr((65 + length(question) % 4)::INTEGER) AS label, 'train,' || doc_id || ',' || q AS idx, 1::INTEGER AS num_choices, array_to_string(aw, '|') AS choices FROM answers""",
)
def _(t):
    letters = F.array(*map(F.lit, "ABCD"))
    raw = _base(t).select(
        F.col("doc_id").alias("id"), F.col("text").alias("article"), F.col("ls").alias("questions"),
        F.transform("ls", lambda line: T.split_words(line)).alias("options"),
        F.transform("ls", lambda line: F.get(letters, F.length(line) % 4)).alias("answers"))
    df = E.TASKS["race"].build(raw, "train", carry=F.md5)
    return df.select("*", F.array_join("meta.choices", "|").alias("choices")).drop("meta")

# Entities are the words of the text, which has single spaces; the answers of a question are two of them.
RECORD = f"""{BASE}, spots AS (SELECT doc_id, array_to_string(ws, ' ') AS text, ls, ws AS raw FROM base WHERE len(ws) > 0),
ents AS (SELECT *, list_sort(list_distinct(raw)) AS ents FROM spots),
qs AS (SELECT *, unnest(range(len(ls)))::INTEGER AS q, unnest(ls) AS question FROM ents),
ans AS (SELECT *, list_sort(list_distinct([raw[q % len(raw) + 1], raw[(q + 7) % len(raw) + 1]])) AS ans FROM qs)"""

def _record(t):
    text = F.array_join("ws", " ")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    starts = A.let(chars, lambda cs: F.filter(A.indices(cs), lambda i: (i == 0) | (F.get(cs, i - 1) == " ")))
    entities = F.zip_with(starts, "ws", lambda s, w: F.struct(s.alias("start"), (s + F.length(w) - 1).alias("end")))
    at = lambda k: F.struct(F.get("ws", (k % F.size("ws")).cast("int")).alias("text"))
    qas = F.transform("ls", lambda line, i: F.struct(i.alias("idx"), line.alias("query"), F.array(at(i), at(i + 7)).alias("answers")))
    return _base(t).filter(F.size("ws") > 0).select(F.col("doc_id").alias("idx"), F.struct(text.alias("text"), entities.alias("entities")).alias("passage"), qas.alias("qas"))


def _record_flat(df):
    meta = [F.array_join("meta.candidates", "|").alias("candidates"), F.array_join("meta.answers", "|").alias("answers")]
    return df.select("*", *meta).drop("meta")

@query(
    "tsk09_entity_cloze_train",
    f"""WITH {RECORD}, a AS (SELECT *, unnest(range(len(ans)))::INTEGER AS k, unnest(ans) AS answer FROM ans),
    wrong AS (SELECT *, list_filter(ents, lambda e: NOT list_contains(ans, e)) AS w FROM a),
    drawn AS (SELECT *, list_reduce(list_prepend([]::BIGINT[], list_transform(range(1, 10), lambda i: [{h_below("len(w) - 9 + i", 42, "doc_id", "q", "k", "i")}, len(w) - 10 + i])),
      lambda acc, x: list_append(acc, CASE WHEN list_contains(acc, x[1]) THEN x[2] ELSE x[1] END)) AS places FROM wrong WHERE len(w) > 9),
    cands AS (SELECT doc_id, text, q, k, question, answer, list_transform(places, lambda p: w[p + 1]) AS c FROM drawn UNION ALL SELECT doc_id, text, q, k, question, answer, w FROM wrong WHERE len(w) <= 9)
    SELECT 'train-p' || doc_id || '-q' || q || '-a' || k AS guid, md5(replace(text, '@highlight' || chr(10), '- ')) AS text_a, question AS text_b, '0' AS label, doc_id || ',' || q || ',' || k AS idx,
      (len(c) + 1)::INTEGER AS num_choices, array_to_string([answer] || c, '|') AS candidates, answer AS answers FROM cands""",
)
def _(t):
    return _record_flat(E.TASKS["record"].build(_record(t), "train", carry=F.md5))

@query(
    "tsk09_entity_cloze_dev",
    f"""WITH {RECORD} SELECT 'dev-p' || doc_id || '-q' || q AS guid, md5(replace(text, '@highlight' || chr(10), '- ')) AS text_a, question AS text_b, '1' AS label, q::VARCHAR AS idx,
      len(ents)::INTEGER AS num_choices, array_to_string(ents, '|') AS candidates, array_to_string(ans, '|') AS answers FROM ans""",
)
def _(t):
    return _record_flat(E.TASKS["record"].build(_record(t), "dev", carry=F.md5))

def _table(name, task, columns, label=None, std=True, with_idx=False, two=True):
    """Register a table task: text columns are the whole text and the first line."""
    idx = "doc_id::VARCHAR" if with_idx else "'-1'"

    @query(name, _sql("'train-' || doc_id::VARCHAR", "text", "ls[1]" if two else "NULL::VARCHAR", "lang" if label else "NULL::VARCHAR", idx, std=std))
    def plan(t):
        raw = _base(t).select(
            F.col("doc_id").alias("line_no"), F.col("text").alias(columns[0]), *([_line(0).alias(columns[1])] if two else []), *([F.col("lang").alias(label)] if label else []))
        return E.TASKS[task].build(raw, "train")

_table("tsk10_mnli", "mnli", ("sentence1", "sentence2"), "gold_label")
_table("tsk11_sst2", "sst2", ("sentence",), "label", two=False)
_table("tsk12_cola", "cola", ("text",), "label", two=False)
_table("tsk13_mrpc", "mrpc", ("#1 String", "#2 String"), "Quality")
_table("tsk14_qqp", "qqp", ("question1", "question2"), "is_duplicate")
_table("tsk15_qnli", "qnli", ("question", "sentence"), "label")
_table("tsk20_tnews", "tnews", ("sentence", "keywords"), "label", std=False, with_idx=True)
_table("tsk21_afqmc", "afqmc", ("sentence1", "sentence2"), std=False, with_idx=True)

ESCAPED = "replace(text, chr(10), '\\n')"
CLEAN = "replace(replace({}, '\\n', ' '), '\\', ' ')"

def _escaped(t):
    return _base(t).select("*", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("esc"), F.col("doc_id").alias("line_no"))

@query("tsk16_topic_news", _sql("'train-' || doc_id::VARCHAR", "replace(rest, '\\', ' ')", f"replace({ESCAPED}, '\\', ' ')", "lang"))
def _(t):
    raw = _escaped(t).select("line_no", F.col("lang").alias("label"), F.col("rest").alias("headline"), F.col("esc").alias("body"))
    return E.TASKS["agnews"].build(raw, "train")

@query("tsk17_topic_question", _sql("'train-' || doc_id::VARCHAR", "source || ' ' || " + CLEAN.format(ESCAPED), CLEAN.format("replace(rest, chr(10), '\\n')"), "lang"))
def _(t):
    raw = _escaped(t).select("line_no", F.col("lang").alias("label"), F.col("source").alias("title"), F.col("esc").alias("body"), F.replace("rest", F.lit("\n"), F.lit("\\n")).alias("answer"))
    return E.TASKS["yahoo"].build(raw, "train")

@query("tsk18_review", _sql("'dev-' || doc_id::VARCHAR", CLEAN.format(ESCAPED), "NULL::VARCHAR", "lang"))
def _(t):
    return E.TASKS["yelp-full"].build(_escaped(t).select("line_no", F.col("lang").alias("label"), F.col("esc").alias("body")), "dev")

@query("tsk19_stance", _sql("doc_id::VARCHAR", "ls[1]", "text", "source", tail="FROM base WHERE lang = 'de'"))
def _(t):
    raw = _base(t).select(F.col("doc_id").alias("id"), _line(0).alias("question"), F.col("text").alias("comment"), F.col("lang").alias("language"), F.col("source").alias("label"))
    return E.TASKS["xstance-de"].build(raw, "train")

@query("flt04_language_examples", "SELECT lang, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY lang")
def _(t):
    raw = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("question"), F.col("text").alias("comment"), F.col("lang").alias("language"), F.col("lang").alias("label"))
    return E.TASKS["xstance-fr"].build(raw, "train").groupBy(F.col("label").alias("lang")).agg(F.count("*").alias("n"))

# The spans are two words of the text, which has single spaces.
SPANS = f"""spans AS (SELECT *, array_to_string(ws, ' ') AS text, doc_id % len(ws) AS i, (7 * doc_id + 3) % len(ws) AS j FROM (SELECT doc_id, lang, {words("text")} AS ws FROM documents) WHERE len(ws) > 0),
placed AS (SELECT *, length(array_to_string(ws[1:i], ' ')) + (i > 0)::INT AS at1, length(array_to_string(ws[1:j], ' ')) + (j > 0)::INT AS at2, ws[i + 1] AS span1, ws[j + 1] AS span2 FROM spans)"""

def word_spans(ws, number):
    """Two words of a text that a number picks, with their places among the characters of the words joined by spaces."""
    n = F.size(ws)
    i, j = ((k % n).cast("int") for k in (number, 7 * number + 3))
    start = lambda k: F.length(F.array_join(A.head(F.col(ws), k), " ")) + (k > 0).cast("int")
    return F.struct(F.get(ws, i).alias("span1_text"), start(i).alias("span1_index"), F.get(ws, j).alias("span2_text"), start(j).alias("span2_index"))

def _cluewsc(t):
    ws = t.documents.select("doc_id", "lang", T.split_words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    return ws.select(F.col("doc_id").alias("id"), F.array_join("ws", " ").alias("text"), word_spans("ws", F.col("doc_id")).alias("target"), F.col("lang").alias("label"))

@query(
    "tsk22_pronoun_by_character",
    f"WITH {SPANS} SELECT 'dev-' || doc_id AS guid, text AS text_a, at1::VARCHAR AS text_b, lang AS label, doc_id::VARCHAR AS idx, 1::INTEGER AS num_choices, span1 AS span1_text, span2 AS span2_text, "
    "at1::INTEGER AS span1_index, at2::INTEGER AS span2_index, length(span1)::INTEGER AS span1_length, length(span2)::INTEGER AS span2_length FROM placed",
)
def _(t):
    return E.TASKS["cluewsc"].build(_cluewsc(t), "dev").select("*", "meta.*").drop("meta")

# One article per document; each line asks for its words, and every third question has no answer.
def _squad(t, *keys):
    answers = lambda line, i, at: F.when((F.col("doc_id") + i) % 3 == 0, F.array().cast("array<struct<text:string,answer_start:int>>")).otherwise(
        F.transform(T.split_words(line), lambda w: F.struct(w.alias("text"), (at + F.length(w)).cast("int").alias("answer_start"))))
    qas = A.let(F.instr("text", "a"), lambda at: F.transform("ls", lambda line, i: F.struct(
        F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string")).alias("id"), line.alias("question"), answers(line, i, at).alias("answers"))))
    paragraph = F.struct(F.col("text").alias("context"), qas.alias("qas"))
    return _base(t).select(*keys, F.array(F.struct(F.array(paragraph).alias("paragraphs"))).alias("data"))

SQUAD = f"{QUESTIONS}, sq AS (SELECT doc_id, text, q, question, CASE WHEN (doc_id + q) % 3 = 0 THEN []::VARCHAR[] ELSE aw END AS aw FROM answers)"

@query(
    "tsk23_passage_cloze",
    f"""WITH {SQUAD} SELECT doc_id || '-' || q AS guid, md5(text) AS text_a, question AS text_b, '0' AS label, '-1' AS idx, 1::INTEGER AS num_choices, coalesce(aw[1], 'N/A') AS answer, array_to_string(aw, '|') AS answers FROM sq""",
)
def _(t):
    df = E.TASKS["squad"].build(_squad(t), "dev", carry=F.md5)
    return df.select("*", "meta.answer", F.array_join("meta.answers", "|").alias("answers")).drop("meta")

@query(
    "tsk24_passage_cloze_numbered",
    f"""WITH {QUESTIONS} SELECT 'train-' || doc_id || '-' || q AS guid, md5(text) AS text_a, question AS text_b, '0' AS label, '-1' AS idx, 1::INTEGER AS num_choices, aw[1] AS answer FROM answers""",
)
def _(t):
    qas = F.transform("ls", lambda line: F.struct(line.alias("query_text"), T.split_words(line).alias("answers")))
    raw = _base(t).select(F.concat(F.lit("TRAIN_"), F.col("doc_id").cast("string")).alias("context_id"), F.col("text").alias("context_text"), qas.alias("qas"))
    return E.TASKS["qa-cn"].build(raw, "train", carry=F.md5).select("*", "meta.answer").drop("meta")

def _pairs_of_lines(t):
    return _base(t).select(F.col("doc_id").alias("line_no"), F.col("text").alias("source"), _line(0).alias("target"))

HEADLINE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, 'UNK', '[UNK]'), '<unk>', '[UNK]'), '-lrb-', '('), '-rrb-', ')'), '-lsb-', '['), '-rsb-', ']'), '-lcb-', '{{'), '-rcb-', '}}'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"

@query(
    "tsk25_summaries",
    f"""WITH {BASE} SELECT 'train-' || doc_id AS guid, {HEADLINE.format(STD.format("replace(text, 'Th', 'UNK')"))} AS text_a, {HEADLINE.format(STD.format("ls[1]"))} AS text_b, NULL::VARCHAR AS label, '-1' AS idx,
      1::INTEGER AS num_choices, {HEADLINE.format(STD.format("ls[1]"))} AS ref FROM base""",
)
def _(t):
    pairs = _pairs_of_lines(t).withColumn("source", F.replace("source", F.lit("Th"), F.lit("UNK")))
    return E.paired_texts(pairs, "train", T.detokenize_headline).select("*", "meta.ref").drop("meta")

@query(
    "tsk27_answer_generation",
    f"""WITH {SQUAD}, a AS (SELECT doc_id, text, q, question, unnest(list_distinct(aw)) AS answer FROM sq)
    SELECT 'train-' || doc_id || '-' || q || '-' || answer AS guid, md5(text) AS text_a, NULL::VARCHAR AS text_b, NULL::VARCHAR AS label, doc_id || '-' || q AS idx, 1::INTEGER AS num_choices, question, answer FROM a""",
)
def _(t):
    return E.answer_generation(_squad(t), "train", carry=F.md5).select("*", "meta.question", "meta.answer").drop("meta")

@query(
    "tsk28_question_generation",
    f"""WITH {SQUAD}, a AS (SELECT doc_id, text, q, question, unnest(list_distinct(aw)) AS answer FROM sq)
    SELECT 'train-' || doc_id || '-' || q || '-' || answer AS guid, question, answer, (instr(text, 'a') + length(answer))::INTEGER AS answer_start FROM a""",
)
def _(t):
    return E.question_generation(_squad(t), "train", carry=F.md5).select("guid", "meta.question", "meta.answer", "meta.answer_start")

@query("tsk30_plain_pairs", f"WITH {BASE} SELECT 'test-' || doc_id AS guid, text AS text_a, ls[1] AS text_b FROM base")
def _(t):
    return E.paired_texts(_pairs_of_lines(t), "test", standardize=False).select("guid", "text_a", "text_b")

@query(
    "tsk31_blanked_sources",
    f"WITH {BASE} SELECT 'test-' || doc_id AS guid, replace(replace(replace(text, ' of ', ' <blank> '), '_UNK', '[UNK]'), '<blank>', '[MASK]') AS text_a, text AS text_b FROM base",
)
def _(t):
    pairs = _base(t).select(F.col("doc_id").alias("line_no"), F.replace("text", F.lit(" of "), F.lit(" <blank> ")).alias("source"), F.col("text").alias("target"))
    return E.paired_texts(pairs, "test", T.blanks_in, standardize=False).select("guid", "text_a", "text_b")

@query(
    "tsk34_multiple_choice",
    f"""WITH {BASE}, raw AS (SELECT doc_id, {codes("text")} || [50003] AS inputs, list_transform(ls, lambda l: {codes("l")}) AS cs FROM base),
    room AS (SELECT *, 510 - list_max(list_transform(cs, lambda c: len(c))) AS room FROM raw),
    cut AS (SELECT *, CASE WHEN len(inputs) > room THEN inputs[len(inputs) - greatest(room, 0) + 1 :] ELSE inputs END AS kept FROM room)
    SELECT doc_id, unnest(range(len(cs)))::INTEGER AS choice_no, {joined("kept")} AS inputs, unnest(list_transform(cs, lambda c: {joined("c")})) AS choice, 0 AS label FROM cut""",
)
def _(t):
    raw = _base(t).select("doc_id", F.col("text").alias("inputs_pretokenized"), F.col("ls").alias("choices_pretokenized"), F.lit(None).cast("int").alias("label"))
    return _show(E.multiple_choice(raw, ["doc_id"], encode_chars, 50003, 512), "inputs", "choice")

@query("tsk36_label_distribution", "SELECT CASE WHEN doc_id % 5 > 0 THEN lang END AS label, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return E.label_distribution(E.TASKS["rte"].build(_pairs(t, "premise", "hypothesis"), "train"))
