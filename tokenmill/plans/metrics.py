"""Scores over the tables: embeddings stand for choice scores, events for loss logs, text pairs for answers."""

from pyspark.sql import functions as F

from tokenmill.functions import arrays as A
from tokenmill.functions import text as T
from tokenmill.operators import metrics as M
from tokenmill.plans.registry import query
from tokenmill.plans.sqltext import words
from tokenmill.plans.vocab import SENTENCES_SQL

# A score for every component of a vector; the prediction is the highest one.
SCORES = """scores AS (SELECT vec_id, label, unnest(range(len(embedding)))::INTEGER AS choice, unnest(embedding)::DOUBLE AS score FROM embeddings),
preds AS (SELECT vec_id, label, arg_max(choice, (score, -choice)) AS prediction FROM scores GROUP BY vec_id, label)"""


def _scores(t):
    return t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("choice", "score")).withColumn("score", F.col("score").cast("double"))


def _predictions(t):
    return M.best_choice(_scores(t), ["vec_id", "label"])


def _round(df):
    return df.select(*[F.round(c, 6).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])


@query("agg01_accuracy", f"WITH {SCORES} SELECT round(100.0::DOUBLE * avg((prediction = label)::INT), 6) AS accuracy FROM preds")
def _(t):
    return _round(M.accuracy(_predictions(t)))


@query(
    "agg03_f1_binary",
    f"""WITH {SCORES}, b AS (SELECT (prediction < 5)::INT AS p, (label < 5)::INT AS l FROM preds)
    SELECT round(2.0::DOUBLE * sum(p * l) / (sum(p) + sum(l)), 6) AS f1 FROM b""",
)
def _(t):
    binary = _predictions(t).select((F.col("prediction") < 5).cast("int").alias("prediction"), (F.col("label") < 5).cast("int").alias("label"))
    return _round(M.f1_binary(binary))


@query(
    "agg04_f1_macro",
    f"""WITH {SCORES}, c AS (SELECT prediction AS c FROM preds UNION SELECT label FROM preds),
    f AS (SELECT c, 2.0::DOUBLE * count(*) FILTER (WHERE prediction = c AND label = c) / (count(*) FILTER (WHERE prediction = c) + count(*) FILTER (WHERE label = c)) AS f1 FROM preds, c GROUP BY c)
    SELECT round(avg(f1), 6) AS f1_macro FROM f""",
)
def _(t):
    return _round(M.f1_macro(_predictions(t)))


@query(
    "agg05_combined_scores",
    """WITH s AS (SELECT lang, 'quality' AS metric, avg(quality) AS value, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang
      UNION ALL SELECT lang, 'toxic', avg(toxic), count(*) FROM labels JOIN documents USING (doc_id) GROUP BY lang)
    SELECT metric, round(sum(value * n) / sum(n), 6) AS value FROM s GROUP BY metric""",
)
def _(t):
    joined = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    rows = joined.select("lang", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("quality", "toxic")])).alias("x"))
    scores = rows.groupBy("lang", "x.metric").agg(F.avg("x.v").alias("value"), F.count("*").alias("n"))
    return _round(M.combined_scores(scores))


# An answer is a line of a document, the truths are the lines before and after it.
NORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace(strip_accents(lower({})), 'ß', 'ss'), '[[:punct:]]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
LINES = """lines AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
truths AS (SELECT a.doc_id, a.line_no, a.line AS prediction, b.line_no AS truth_no, b.line AS truth FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND abs(a.line_no - b.line_no) = 1)"""


def _truths(t, of=lambda line: line):
    """Lines, and lines with their neighbours; of a line `of` is taken, once."""
    beside = A.let(F.transform(F.split("text", "\n"), of), lambda ls: F.transform(
        ls, lambda line, i: F.struct(line.alias("line"), F.get(ls, i - 1).alias("before"), F.get(ls, i + 1).alias("after"))))
    around = t.documents.select("doc_id", F.posexplode(beside).alias("line_no", "x")).select("doc_id", "line_no", "x.*")
    both = F.array(
        F.struct((F.col("line_no") - 1).alias("truth_no"), F.col("before").alias("truth")),
        F.struct((F.col("line_no") + 1).alias("truth_no"), F.col("after").alias("truth")))
    rows = around.select("doc_id", "line_no", F.col("line").alias("prediction"), F.explode(both).alias("t")).select("doc_id", "line_no", "prediction", "t.*")
    return around.select("doc_id", "line_no", "line"), rows.filter(F.col("truth").isNotNull())


@query("agg06_exact_match", f"WITH {LINES} SELECT doc_id, line_no, truth_no, ({NORM.format('prediction')} = {NORM.format('truth')})::INT::DOUBLE AS em FROM truths")
def _(t):
    _, truths = _truths(t)
    return truths.select("doc_id", "line_no", "truth_no", M.exact_match(F.col("prediction"), F.col("truth")).alias("em"))


BAGS = f"""{LINES}, sides AS (SELECT doc_id, line_no, truth_no, unnest({words(NORM.format("prediction"))}) AS w, 1 AS a, 0 AS b FROM truths
  UNION ALL SELECT doc_id, line_no, truth_no, unnest({words(NORM.format("truth"))}), 0, 1 FROM truths),
counts AS (SELECT doc_id, line_no, truth_no, w, sum(a) AS a, sum(b) AS b FROM sides GROUP BY ALL),
f1s AS (SELECT doc_id, line_no, truth_no, CASE WHEN sum(least(a, b)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * sum(least(a, b)) / (sum(a) + sum(b)) END AS f1 FROM counts GROUP BY ALL)"""


def _line_f1(t):
    _, truths = _truths(t, M.answer_words)
    _, texts = _truths(t)
    return M.token_f1(truths, ["doc_id", "line_no", "truth_no"], "prediction", "truth", words=lambda ws: ws, keyed=texts)


@query("agg07_token_f1", f"WITH {BAGS} SELECT doc_id, line_no, truth_no, round(coalesce(f1, 0), 6) AS f1 FROM truths LEFT JOIN f1s USING (doc_id, line_no, truth_no)")
def _(t):
    return _round(_line_f1(t))


@query(
    "agg08_best_over_truths",
    f"""WITH {BAGS}, best AS (SELECT doc_id, line_no, max(f1) AS f1 FROM f1s GROUP BY ALL)
    SELECT round(100.0::DOUBLE * avg(coalesce(f1, 0)), 6) AS f1 FROM lines LEFT JOIN best USING (doc_id, line_no)""",
)
def _(t):
    lines, _ = _truths(t)
    scored = _line_f1(t)
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("q")
    return _round(M.best_over_truths(scored.select(key, "f1"), lines.select(key), "q", "f1"))


# Windows of a question are the lines of a document; every third line, and all of every fifth document, has no answer.
WINDOWED = f"""raw AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
preds AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 OR doc_id % 5 = 0 THEN 'N / A' ELSE line END AS prediction FROM raw),
firsts AS (SELECT doc_id, coalesce(arg_min(prediction, line_no) FILTER (WHERE lower(replace(prediction, ' ', '')) <> 'n/a'), 'N/A') AS prediction FROM preds GROUP BY doc_id),
answers AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'N/A' ELSE string_split(text, chr(10))[1] END AS answer FROM documents),
rows AS (SELECT doc_id, prediction, answer FROM firsts JOIN answers USING (doc_id)),
sides AS (SELECT doc_id, unnest({words(NORM.format("prediction"))}) AS w, 1 AS a, 0 AS b FROM rows UNION ALL SELECT doc_id, unnest({words(NORM.format("answer"))}), 0, 1 FROM rows),
counts AS (SELECT doc_id, w, sum(a) AS a, sum(b) AS b FROM sides GROUP BY ALL),
f1s AS (SELECT doc_id, CASE WHEN sum(least(a, b)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * sum(least(a, b)) / (sum(a) + sum(b)) END AS f1 FROM counts GROUP BY doc_id)"""


def _windows(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    blank = (F.col("line_no") % 3 == 0) | (F.col("doc_id") % 5 == 0)
    return lines.select("doc_id", "line_no", F.when(blank, "N / A").otherwise(F.col("line")).alias("prediction"))


@query(
    "agg09_answers_with_windows",
    f"""WITH {WINDOWED} SELECT round(100.0::DOUBLE * avg(CASE WHEN answer = 'N/A' THEN (prediction = 'N/A')::INT ELSE ({NORM.format("prediction")} = {NORM.format("answer")})::INT END), 6) AS em,
      round(100.0::DOUBLE * avg(CASE WHEN answer = 'N/A' THEN (prediction = 'N/A')::INT ELSE coalesce(f1, 0) END), 6) AS f1 FROM rows LEFT JOIN f1s USING (doc_id)""",
)
def _(t):
    truths = t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "N/A").otherwise(F.split("text", "\n")[0]).alias("answer"))
    return _round(M.answers_with_windows(_windows(t), truths, "doc_id", "line_no"))


@query("win04_first_answered", f"WITH {WINDOWED} SELECT doc_id, prediction FROM firsts")
def _(t):
    return M.first_answered(_windows(t), "doc_id", "line_no", "prediction")


@query(
    "agg10_all_answers_right",
    """WITH q AS (SELECT l_orderkey, bool_and((l_returnflag = 'N') = (l_linestatus = 'O')) AS ok FROM lineitem GROUP BY l_orderkey) SELECT round(avg(ok::INT), 6) AS em FROM q""",
)
def _(t):
    answers = t.lineitem.select("l_orderkey", (F.col("l_returnflag") == "N").alias("prediction"), (F.col("l_linestatus") == "O").alias("label"))
    return _round(M.all_answers_right(answers, "l_orderkey"))


# Text pairs: a user turn and the assistant turn behind it.
PAIRS = """turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS reference, answer AS prediction FROM turns WHERE role = 'user' AND next_role = 'assistant')"""


def _pairs(t):
    # A join on the next turn, not a window over the conversation: a huge conversation spreads over all tasks.
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    answered = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return asked.join(answered, ["conv_id", "turn"])


def _rouge_sql(n):
    grams = lambda c: f"list_transform(range(greatest(len(regexp_extract_all(lower({c}), '[a-z0-9]+')) - {n - 1}, 0)), lambda i: array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+')[i + 1 : i + {n}], ' '))"
    return f"""WITH {PAIRS}, sides AS (SELECT conv_id, turn, unnest({grams("prediction")}) AS g, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT conv_id, turn, unnest({grams("reference")}), 0, 1 FROM pairs),
    counts AS (SELECT conv_id, turn, g, sum(a) AS a, sum(b) AS b FROM sides GROUP BY ALL),
    f AS (SELECT conv_id, turn, CASE WHEN sum(least(a, b)) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * sum(least(a, b)) / (sum(a) + sum(b)) END AS f FROM counts GROUP BY ALL)
    SELECT conv_id, turn, round(coalesce(f, 0), 6) AS rouge FROM pairs LEFT JOIN f USING (conv_id, turn)"""


@query("agg11_rouge_1", _rouge_sql(1))
def _(t):
    return _round(M.rouge_n(_pairs(t), ["conv_id", "turn"], "prediction", "reference", 1))


@query("agg11_rouge_2", _rouge_sql(2))
def _(t):
    return _round(M.rouge_n(_pairs(t), ["conv_id", "turn"], "prediction", "reference", 2))


# A row of the table of common lengths is a number of up to 127 bits here; the walk back is a second recursion.
_SIDE_SQL = "list_filter(list_transform({}, lambda s: regexp_extract_all(lower(s), '[a-z0-9]+')), lambda ws: len(ws) > 0)"
ROUGE_L_SQL = f"""WITH RECURSIVE {PAIRS},
    sides AS (SELECT conv_id, turn, {_SIDE_SQL.format(SENTENCES_SQL.format("prediction"))} AS p, {_SIDE_SQL.format(SENTENCES_SQL.format("reference"))} AS r FROM pairs),
    ps AS (SELECT conv_id, turn, r, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS a FROM sides),
    met AS (SELECT conv_id, turn, i, a, unnest(range(1, len(r) + 1)) AS k, unnest(r) AS b FROM ps),
    rows AS (SELECT conv_id, turn, i, k, a, b, 0 AS n, [(1::HUGEINT << len(b)) - 1] AS vs FROM met
      UNION ALL SELECT conv_id, turn, i, k, a, b, n + 1, list_append(vs, ((v + (v & m)) | (v & xor(m, o))) & o) FROM (
        SELECT *, vs[n + 1] AS v, (1::HUGEINT << len(b)) - 1 AS o, list_sum(list_transform(range(len(b)), lambda j: CASE WHEN b[j + 1] = a[n + 1] THEN 1::HUGEINT << j ELSE 0::HUGEINT END))::HUGEINT AS m
        FROM rows WHERE n < len(a))),
    walk AS (SELECT conv_id, turn, i, k, a, b, vs, len(a) AS x, len(b) AS y, []::BIGINT[] AS found FROM rows WHERE n = len(a)
      UNION ALL SELECT conv_id, turn, i, k, a, b, vs, CASE WHEN same OR NOT back THEN x - 1 ELSE x END, CASE WHEN same OR back THEN y - 1 ELSE y END, CASE WHEN same THEN list_append(found, x) ELSE found END FROM (
        SELECT *, a[x] = b[y] AS same, y - 1 - bit_count(vs[x + 1] & ((1::HUGEINT << (y - 1)) - 1)) > y - bit_count(vs[x] & ((1::HUGEINT << y) - 1)) AS back FROM walk WHERE x > 0 AND y > 0)),
    covered AS (SELECT DISTINCT conv_id, turn, i, pos, a[pos] AS token FROM (SELECT conv_id, turn, i, a, unnest(found) AS pos FROM walk WHERE x = 0 OR y = 0)),
    c AS (SELECT conv_id, turn, token, count(*) AS c FROM covered GROUP BY ALL),
    h AS (SELECT conv_id, turn, token, count(*) AS h FROM (SELECT conv_id, turn, unnest(flatten(r)) AS token FROM sides) GROUP BY ALL),
    hits AS (SELECT conv_id, turn, sum(least(c, h)) AS hits FROM c JOIN h USING (conv_id, turn, token) GROUP BY ALL)
    SELECT conv_id, turn, round(CASE WHEN hits IS NULL THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * hits / (len(flatten(p)) + len(flatten(r))) END, 6) AS rouge FROM sides LEFT JOIN hits USING (conv_id, turn)"""


@query("agg12_rouge_l", ROUGE_L_SQL)
def _(t):
    df = M.rouge_l(_pairs(t), ["conv_id", "turn"], T.sentences(F.col("prediction")), T.sentences(F.col("reference")))
    return _round(df)


def _bleu_sql():
    grams = lambda c: f"flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(greatest(len({c}) - n + 1, 0)), lambda i: n || ' ' || array_to_string({c}[i + 1 : i + n], ' '))))"
    return f"""WITH {PAIRS}, ws AS (SELECT conv_id || ':' || turn AS id, {words("lower(prediction)")} AS h, {words("lower(reference)")} AS r1 FROM pairs),
    three AS (SELECT id, h, r1, h[4:] AS r2 FROM ws),
    g AS (SELECT id, -1 AS ref, unnest({grams("h")}) AS g FROM three UNION ALL SELECT id, 0, unnest({grams("r1")}) FROM three UNION ALL SELECT id, 1, unnest({grams("r2")}) FROM three),
    c AS (SELECT id, ref, g, count(*) AS c FROM g GROUP BY ALL),
    m AS (SELECT id, g, max(c) FILTER (WHERE ref = -1) AS h, max(c) FILTER (WHERE ref >= 0) AS r FROM c GROUP BY ALL),
    p AS (SELECT substr(g, 1, 1)::INT AS n, sum(least(h, coalesce(r, 0)))::DOUBLE / sum(h) AS p FROM m WHERE h IS NOT NULL GROUP BY 1),
    l AS (SELECT sum(len(h))::BIGINT AS hyp_len, sum(CASE WHEN abs(len(r1) - len(h)) < abs(len(r2) - len(h)) THEN len(r1) WHEN abs(len(r1) - len(h)) > abs(len(r2) - len(h)) THEN len(r2) ELSE least(len(r1), len(r2)) END)::BIGINT AS ref_len FROM three),
    one AS (SELECT max(p) FILTER (WHERE n = 1) AS p1, max(p) FILTER (WHERE n = 2) AS p2, max(p) FILTER (WHERE n = 3) AS p3, max(p) FILTER (WHERE n = 4) AS p4 FROM p)
    SELECT round(100.0::DOUBLE * CASE WHEN hyp_len < ref_len THEN exp(1.0::DOUBLE - ref_len / hyp_len::DOUBLE) ELSE 1.0::DOUBLE END * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 6) AS bleu,
      round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, hyp_len, ref_len FROM one, l"""


@query("agg13_corpus_bleu", _bleu_sql())
def _(t):
    # Two references: the user turn, and the answer without its first three words.
    shorter = F.array_join(F.expr("slice(ws, 4, size(ws))"), " ")
    pairs = _pairs(t).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "prediction", "reference", T.split_words(F.col("prediction")).alias("ws"))
    return _round(M.corpus_bleu(pairs, "id", F.col("prediction"), F.array(F.col("reference"), shorter), lower=True))


@query(
    "agg14_smoothed_f1",
    f"""WITH {PAIRS}, sides AS (SELECT conv_id, turn, unnest({words("lower(prediction)")}) AS w, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT conv_id, turn, unnest({words("lower(reference)")}), 0, 1 FROM pairs),
    counts AS (SELECT conv_id, turn, w, sum(a) AS a, sum(b) AS b FROM sides GROUP BY ALL),
    pr AS (SELECT conv_id, turn, sum(least(a, b))::DOUBLE / sum(a) AS p, sum(least(a, b))::DOUBLE / sum(b) AS r FROM counts GROUP BY ALL)
    SELECT conv_id, turn, round(2.0::DOUBLE * p * r / (p + r + 0.00001::DOUBLE), 6) AS f1 FROM pr""",
)
def _(t):
    return _round(M.smoothed_f1(_pairs(t), ["conv_id", "turn"], "prediction", "reference"))


@query(
    "agg15_perplexity",
    """WITH s AS (SELECT sum(value / 100 * (user_id % 2)) AS s, count(*) AS t, count(*) FILTER (WHERE event_type <> 'view') AS o FROM events)
    SELECT round(s / (t - 1), 6) AS avg_loss, round(exp(least(20, s / (t - 1))), 6) AS ppl, round(exp(least(20, s / (t - 1) * ((t - 1) / (o - 1)::DOUBLE))), 6) AS adjusted_ppl, round((t - 1) / (o - 1)::DOUBLE, 6) AS token_ratio FROM s""",
)
def _(t):
    losses = t.events.select((F.col("value") / 100).alias("loss"), (F.col("user_id") % 2).alias("mask"), "event_type")
    return _round(M.perplexity(losses, F.count("*"), F.sum((F.col("event_type") != "view").cast("int"))))


@query(
    "agg16_cloze_accuracy",
    "WITH u AS (SELECT user_id, bool_and(event_type <> 'click' OR value > 2) AS ok FROM events GROUP BY user_id) SELECT round(100.0::DOUBLE * avg(ok::INT), 6) AS accuracy FROM u",
)
def _(t):
    tokens = t.events.select("user_id", (F.col("value") > 2).alias("correct"), (F.col("event_type") == "click").cast("int").alias("mask"))
    return _round(M.cloze_accuracy(tokens, "user_id"))


# All 64 components as token scores of ten choices: component i belongs to choice i % 10 and is scored unless i % 3 = 0.
TOKENS = """tokens AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS score FROM embeddings),
sums AS (SELECT vec_id, label, (i % 10)::INTEGER AS choice, sum(score * (i % 3 > 0)::INT) / pow(sum((i % 3 > 0)::INT)::DOUBLE, 0.7::DOUBLE) AS score FROM tokens GROUP BY ALL)"""


def _token_scores(t):
    rows = t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "score"))
    rows = rows.select("vec_id", "label", (F.col("i") % 10).alias("choice"), F.col("score").cast("double").alias("score"), (F.col("i") % 3 > 0).cast("int").alias("mask"))
    return M.choice_scores(rows, ["vec_id", "label"], length_penalty=0.7)


@query("agg17_choice_scores", f"WITH {TOKENS} SELECT vec_id, label, choice, round(score, 6) AS score FROM sums")
def _(t):
    return _round(_token_scores(t))


@query("agg17_best_choice", f"WITH {TOKENS} SELECT vec_id, label, arg_max(choice, (CASE WHEN choice < 7 THEN round(score, 6) ELSE -10000 END, -choice)) AS prediction FROM sums GROUP BY vec_id, label")
def _(t):
    return M.best_choice(_round(_token_scores(t)), ["vec_id", "label"], valid=F.col("choice") < 7)


@query("agg18_inverted_prediction", f"WITH {SCORES} SELECT vec_id, CASE WHEN prediction = 0 THEN 1 ELSE 0 END AS prediction FROM preds")
def _(t):
    return _predictions(t).select("vec_id", M.inverted(F.col("prediction")).alias("prediction"))


MODE = "CASE event_type WHEN 'click' THEN 'gpt' WHEN 'view' THEN 'bert' WHEN 'error' THEN 'sentence' ELSE 'other' END"


@query(
    "agg19_objective_losses",
    f"""WITH l AS (SELECT {MODE} AS mode, value / 100 AS loss FROM events)
    SELECT round(avg(loss), 6) AS total, round(coalesce(avg(loss) FILTER (WHERE mode = 'gpt'), 0), 6) AS generation, round(coalesce(avg(loss) FILTER (WHERE mode = 'bert'), 0), 6) AS token,
      round(coalesce(avg(loss) FILTER (WHERE mode = 'sentence'), 0), 6) AS sentence, round(coalesce(avg(loss) FILTER (WHERE mode = 'multi-task'), 0), 6) AS multi_task, round(exp(least(20, avg(loss))), 6) AS ppl FROM l""",
)
def _(t):
    mode = F.expr(MODE)
    return _round(M.objective_losses(t.events.select(mode.alias("mode"), (F.col("value") / 100).alias("loss"))))


@query(
    "agg20_log_intervals",
    "SELECT ((event_id // 50) + 1) * 50 AS iteration, round(avg(value), 6) AS avg_loss, round(avg(user_id), 6) AS avg_ms FROM events GROUP BY event_id // 50",
)
def _(t):
    log = t.events.select((F.col("event_id") + 1).alias("iteration"), F.col("value").alias("loss"), F.col("user_id").alias("elapsed_ms"))
    return _round(M.log_intervals(log, 50))


@query("agg21_best_evaluation", "SELECT user_id, arg_min(event_id, (-value, event_id)) AS epoch, max(value) AS score FROM events GROUP BY user_id")
def _(t):
    evaluations = t.events.select("user_id", F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    return M.best_evaluation(evaluations, ["user_id"], "score")


@query(
    "agg22_run_summary",
    """WITH r AS (SELECT user_id, avg(value) AS accuracy, max(value) AS f1 FROM events GROUP BY user_id), best AS (SELECT arg_max(user_id, (f1, user_id)) AS b FROM r),
    s AS (SELECT user_id, 'accuracy' AS metric, accuracy AS value FROM r UNION ALL SELECT user_id, 'f1', f1 FROM r)
    SELECT metric, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value) FILTER (WHERE user_id = (SELECT b FROM best)), 6) AS at_best_run FROM s GROUP BY metric""",
)
def _(t):
    runs = t.events.groupBy("user_id").agg(F.avg("value").alias("accuracy"), F.max("value").alias("f1"))
    return _round(M.run_summary(runs, ["accuracy", "f1"], "user_id", "f1"))


@query(
    "agg23_task_metrics",
    """WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'multirc' WHEN 'fr' THEN 'cb' WHEN 'de' THEN 'record' ELSE 'rte' END AS task FROM documents),
    m AS (SELECT doc_id, task, CASE task WHEN 'multirc' THEN ['f1a', 'em', 'acc'] WHEN 'cb' THEN ['accuracy', 'f1-macro'] WHEN 'record' THEN ['EM', 'F1'] ELSE ['accuracy'] END AS ms FROM d)
    SELECT doc_id, task, unnest(range(len(ms)))::INTEGER AS metric_no, unnest(ms) AS metric FROM m""",
)
def _(t):
    task = F.when(F.col("lang") == "en", "multirc").when(F.col("lang") == "fr", "cb").when(F.col("lang") == "de", "record").otherwise("rte")
    return M.task_metrics(t.documents.select("doc_id", task.alias("task")))


@query(
    "agg23_evaluated_tasks",
    """WITH p AS (SELECT quality AS p, toxic AS l, doc_id % 50 AS q FROM labels),
    f AS (SELECT 2.0::DOUBLE * count(*) FILTER (p = 1 AND l = 1) / (count(*) FILTER (p = 1) + count(*) FILTER (l = 1)) AS f1, 100.0::DOUBLE * avg((p = l)::INT) AS acc FROM p),
    e AS (SELECT avg(r::INT)::DOUBLE AS em FROM (SELECT q, bool_and(p = l) AS r FROM p GROUP BY q)),
    c AS (SELECT c, (SELECT count(*) FROM p WHERE p = c AND l = c) AS hits, (SELECT count(*) FROM p WHERE p = c) + (SELECT count(*) FROM p WHERE l = c) AS seen
      FROM (SELECT DISTINCT unnest([p, l]) AS c FROM p)),
    d AS (SELECT 100.0::DOUBLE * avg((doc_id % 3 = 0)::INT) AS em, 100.0::DOUBLE * avg(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2.0::DOUBLE / 3 END) AS f1 FROM documents)
    SELECT task, metric_no::INTEGER AS metric_no, metric, round(value, 6) AS value FROM (
      SELECT 'multirc' AS task, 0 AS metric_no, 'f1a' AS metric, (SELECT f1 FROM f) AS value UNION ALL SELECT 'multirc', 1, 'em', (SELECT em FROM e)
      UNION ALL SELECT 'multirc', 2, 'acc', (SELECT acc FROM f) UNION ALL SELECT 'cb', 0, 'accuracy', (SELECT acc FROM f)
      UNION ALL SELECT 'cb', 1, 'f1-macro', (SELECT avg(2.0::DOUBLE * hits / seen) FROM c) UNION ALL SELECT 'rte', 0, 'accuracy', (SELECT acc FROM f)
      UNION ALL SELECT 'record', 0, 'EM', (SELECT em FROM d) UNION ALL SELECT 'record', 1, 'F1', (SELECT f1 FROM d))""",
)
def _(t):
    labels = t.labels.select(F.col("quality").alias("prediction"), F.col("toxic").alias("label"), (F.col("doc_id") % 50).alias("question"))
    said = F.concat_ws(" ", "source", "lang")
    truths = F.when(F.col("doc_id") % 3 == 0, F.array("source", said)).otherwise(F.array("source"))
    answers = t.documents.select(F.col("doc_id").alias("question"), said.alias("prediction"), truths.alias("truths"))
    scores = M.evaluate(labels, "multirc").unionByName(M.evaluate(labels, "cb")).unionByName(M.evaluate(labels, "rte"))
    return _round(scores.unionByName(M.evaluate(answers, "record")))


@query(
    "jon01_predictions_to_examples",
    "SELECT d.doc_id, d.lang, l.quality AS prediction FROM documents d JOIN labels l USING (doc_id)",
)
def _(t):
    return t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", F.col("quality").alias("prediction")), "doc_id")


@query(
    "jon09_ngram_overlap",
    _rouge_sql(2).split("f AS (SELECT")[0].rstrip().rstrip(",") + " SELECT conv_id, turn, sum(least(a, b))::BIGINT AS matched, sum(a)::BIGINT AS n_left, sum(b)::BIGINT AS n_right FROM counts GROUP BY conv_id, turn",
)
def _(t):
    grams = lambda c: M.ngrams(M.rouge_tokens(F.col(c)), 2)
    return M.bag_overlap(_pairs(t), ["conv_id", "turn"], grams("prediction"), grams("reference")).filter("n_left + n_right > 0")
