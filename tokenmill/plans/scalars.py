"""Scalar helpers, set operations and the smaller joins, sorts and tasks that no other family shows on their own."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions import arrays as A
from tokenmill.functions import text as T
from tokenmill.functions.hashing import hash_hex, hash_uniform
from tokenmill.operators import blanks as B
from tokenmill.operators import corpora as C
from tokenmill.operators import examples as E
from tokenmill.operators import sampling as S
from tokenmill.operators import sequences as Q
from tokenmill.operators import vocab as V
from tokenmill.operators.seq2seq import source_tokens, span_text
from tokenmill.operators.special import special_tokens
from tokenmill.operators.vocab import encode_chars
from tokenmill.plans.registry import query
from tokenmill.plans.sequences import TOKS, _passages_sql, _qa, _show, _tokens
from tokenmill.plans.sqltext import codes, h_hex, h_uniform, joined, words
from tokenmill.plans.tasks import BASE, _base
from tokenmill.plans.vocab import TOP_SQL, _vocab

SP = special_tokens()
WS = f"ws AS (SELECT doc_id, text, {words('text')} AS ws FROM documents)"


def _ws(t):
    return t.documents.select("doc_id", "text", T.split_words(F.col("text")).alias("ws"))


@query(
    "sca01_span_text",
    f"""WITH {WS}, p AS (SELECT doc_id, text, trim(ws[2] || ' ' || coalesce(ws[3], '')) AS pred FROM ws WHERE len(ws) >= 2)
    SELECT doc_id, pred AS answer FROM p WHERE contains(text, pred)""",
)
def _(t):
    ws = _ws(t).filter(F.size("ws") >= 2).withColumn("pred", F.trim(F.concat_ws(" ", F.col("ws")[1], F.coalesce(F.get("ws", F.lit(2)), F.lit("")))))
    # Character ids are their own offsets: token i spans the characters [i, i + 1).
    df = ws.filter(F.contains("text", F.col("pred"))).select("doc_id", "text", encode_chars(F.col("text")).alias("tokens"), encode_chars(F.col("pred")).alias("predicted"))
    offsets = F.transform("tokens", lambda _, i: F.struct(i.alias("start"), (i + 1).alias("end")))
    df = df.withColumn("offsets", offsets)
    return df.select("doc_id", span_text(F.col("text"), F.col("tokens"), F.col("offsets"), F.col("predicted"), V.decode_chars(F.col("predicted"))).alias("answer"))


@query(
    "sca02_sublist_positions",
    f"""WITH {WS}, p AS (SELECT doc_id, ws, ws[len(ws) // 2 + 1] AS w FROM ws WHERE len(ws) > 0) SELECT doc_id, {joined("list_filter(range(len(ws)), lambda i: ws[i + 1] = w)")} AS positions FROM p""",
)
def _(t):
    df = _ws(t).filter(F.size("ws") > 0)
    middle = F.array(F.get("ws", F.floor(F.size("ws") / 2).cast("int")))
    return _show(df.select("doc_id", A.sublist_positions(F.col("ws"), middle).alias("positions")), "positions")


@query(
    "sca03_first_and_last_index",
    f"""WITH {WS} SELECT doc_id, coalesce(list_position(ws, 'the'), 0)::INTEGER - 1 AS first, CASE WHEN list_contains(ws, 'the') THEN len(ws) - list_position(list_reverse(ws), 'the') ELSE -1 END::INTEGER AS last FROM ws""",
)
def _(t):
    return _ws(t).select("doc_id", A.first_index(F.col("ws"), F.lit("the")).alias("first"), A.last_index(F.col("ws"), F.lit("the")).alias("last"))


@query(
    "sca04_running_sums",
    """WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    r AS (SELECT doc_id, i, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM raw) SELECT doc_id, string_agg(s::BIGINT::VARCHAR, ' ' ORDER BY i) AS sums FROM r GROUP BY doc_id""",
)
def _(t):
    lengths = F.transform(F.split("text", "\n"), lambda line: F.length(line))
    return _show(t.documents.select("doc_id", A.running_sums(lengths).alias("sums")), "sums")


@query(
    "sca05_array_pieces",
    f"WITH {WS} SELECT doc_id, {joined('ws[3:7]')} AS taken, {joined('ws[1:2]')} AS head, {joined('ws[greatest(len(ws) - 3, 0) + 1:]')} AS tail, {joined('ws[6:]')} AS dropped, {joined('range(5, 5 + len(ws))')} AS counted FROM ws",
)
def _(t):
    ws = F.col("ws")
    df = _ws(t).select("doc_id", A.take(ws, 2, 5).alias("taken"), A.head(ws, 2).alias("head"), A.tail(ws, 3).alias("tail"), A.drop(ws, 5).alias("dropped"), A.counting(5, F.size("ws")).alias("counted"))
    return _show(df, "taken", "head", "tail", "dropped", "counted")


@query(
    "sca06_distinct_words",
    f"WITH {WS}, u AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM ws), f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY ALL) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS ordered, string_agg(w, ' ' ORDER BY w) AS sorted FROM f GROUP BY doc_id",
)
def _(t):
    df = _ws(t).filter(F.size("ws") > 0).select("doc_id", F.array_distinct("ws").alias("ordered"))
    return _show(df.withColumn("sorted", F.array_sort("ordered")), "ordered", "sorted")


@query("sca08_strip", "SELECT doc_id, trim('  ' || text || '  ', ' ' || chr(10)) AS stripped, rtrim(text || '  ', ' ' || chr(10)) AS right_stripped FROM documents")
def _(t):
    padded = F.concat(F.lit("  "), "text", F.lit("  "))
    return t.documents.select("doc_id", T.strip(padded).alias("stripped"), F.regexp_replace(F.concat("text", F.lit("  ")), r"(?U)\s+\z", "").alias("right_stripped"))


@query(
    "sca09_text_tests",
    "SELECT doc_id, starts_with(text, 'The') AS starts, contains(text, 'the') AS holds, lower(replace(lang || ' ', ' ', '')) = 'en' AS same FROM documents",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", text.startswith("The").alias("starts"), F.contains(text, F.lit("the")).alias("holds"), (F.lower(F.replace(F.concat("lang", F.lit(" ")), F.lit(" "), F.lit(""))) == "en").alias("same"))


@query(
    "sca10_split_and_join",
    f"WITH {WS} SELECT doc_id, split_part(text, ' the ', 1) AS first, CASE WHEN contains(text, ' the ') THEN substr(text, instr(text, ' the ') + 5) END AS rest, array_to_string(ws, '_') AS glued FROM ws",
)
def _(t):
    halves = F.split("text", " the ", 2)
    return _ws(t).select("doc_id", halves[0].alias("first"), F.get(halves, F.lit(1)).alias("rest"), F.array_join("ws", "_").alias("glued"))


@query("sca11_last_word", f"WITH {WS} SELECT doc_id, coalesce(ws[-1], '') AS word, (length(text) - instr(reverse(text), reverse(coalesce(ws[-1], ''))) - length(coalesce(ws[-1], '')) + 1)::INTEGER AS at FROM ws WHERE len(ws) > 0".replace(" AS at ", ' AS "at" '))
def _(t):
    word = F.regexp_extract("text", r"(\S+)\s*\z", 1)
    at = F.length("text") - F.instr(F.reverse("text"), F.reverse(word)) - F.length(word) + 1
    return t.documents.filter(F.regexp_like("text", F.lit(r"\S"))).select("doc_id", word.alias("word"), at.cast("int").alias("at"))


@query("sca14_strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", T.strip_accents(F.col("text")).alias("text"))


@query(
    "sca15_number_casts",
    f"WITH {WS}, n AS (SELECT doc_id, unnest(ws) AS w FROM ws) SELECT doc_id, w, coalesce(try_cast(nullif(regexp_replace(w, '[^0-9x]', '', 'g'), '') AS BIGINT), 0) AS n FROM n",
)
def _(t):
    digits = F.regexp_replace("w", "[^0-9x]", "")
    return _ws(t).select("doc_id", F.explode("ws").alias("w")).select("doc_id", "w", F.coalesce(F.nullif(digits, F.lit("")).try_cast("bigint"), F.lit(0)).alias("n"))


@query("sca16_json_fields", "SELECT event_id, (props->>'k')::BIGINT AS k, coalesce(props->>'missing', '') AS missing FROM events")
def _(t):
    parsed = F.from_json("props", "k BIGINT, missing STRING")
    return t.events.select("event_id", parsed.alias("p")).select("event_id", "p.k", F.coalesce("p.missing", F.lit("")).alias("missing"))


@query(
    "sca17_floored_logs",
    "SELECT event_id, round(exp(least(20, value / 10)), 4) AS capped, round(CASE WHEN value > 5 THEN ln(value) ELSE -9999999999 END, 6) AS floored, ceil(value / 7)::BIGINT AS up, event_id // 7 AS whole FROM events",
)
def _(t):
    value = F.col("value")
    return t.events.select(
        "event_id", F.round(F.exp(F.least(F.lit(20.0), value / 10)), 4).alias("capped"), F.round(F.when(value > 5, F.log(value)).otherwise(-9999999999.0), 6).alias("floored"),
        F.ceil(value / 7).alias("up"), F.floor(F.col("event_id") / 7).alias("whole"))


@query(
    "sca18_span_length_shares",
    f"""WITH cdf AS (SELECT [{", ".join(f"{c!r}::DOUBLE" for c in B.span_length_cdf())}] AS c)
    SELECT least(len(list_filter(c, lambda x: x <= {h_uniform("share", "doc_id")})) + 1, 39) AS length, count(*) AS n FROM documents, cdf GROUP BY 1""",
)
def _(t):
    cdf = F.array(*map(F.lit, B.span_length_cdf()))
    u = hash_uniform("share", "doc_id")
    length = A.let(u, lambda x: F.least(F.size(F.filter(cdf, lambda c: c <= x)) + 1, F.lit(39)))
    return t.documents.groupBy(length.cast("bigint").alias("length")).agg(F.count("*").alias("n"))


@query("sca19_row_uniform", f"SELECT doc_id, {h_uniform('row', 'doc_id')} AS u FROM documents")
def _(t):
    return t.documents.select("doc_id", hash_uniform("row", "doc_id").alias("u"))


@query("sca20_templates", "SELECT doc_id, replace('The text of [X] is written.', '[X]', source) AS text, format('train-p{}-q{}', doc_id, n_chars) AS guid FROM documents")
def _(t):
    return t.documents.select("doc_id", F.replace(F.lit("The text of [X] is written."), F.lit("[X]"), F.col("source")).alias("text"), F.format_string("train-p%d-q%d", "doc_id", "n_chars").alias("guid"))


@query(
    "set01_concat_corpora",
    """SELECT 'stories' AS corpus, doc_id, '' AS prompt, text FROM documents WHERE text <> '' UNION ALL SELECT 'openwebtext', doc_id, '', text FROM documents WHERE length(text) > 100 AND lang = 'en'""",
)
def _(t):
    return C.concat_corpora({name: C.CORPORA[name](t.documents) for name in ("stories", "openwebtext")})


@query("set03_shared_words", f"WITH {WS}, p AS (SELECT doc_id, ws, list_distinct(ws[1 : len(ws) // 2]) AS a, list_distinct(ws[len(ws) // 2 + 1 :]) AS b FROM ws) SELECT doc_id, len(list_intersect(a, b))::INTEGER AS shared FROM p")
def _(t):
    half = F.floor(F.size("ws") / 2)
    halves = _ws(t).select("doc_id", A.head(F.col("ws"), half).alias("a"), A.drop(F.col("ws"), half).alias("b"))
    return halves.select("doc_id", F.size(F.array_intersect("a", "b")).alias("shared"))


@query(
    "set04_word_difference",
    f"WITH {WS}, p AS (SELECT doc_id, ws[1 : len(ws) // 2] AS a, ws[len(ws) // 2 + 1 :] AS b FROM ws), d AS (SELECT doc_id, unnest(list_distinct(a)) AS w FROM p EXCEPT SELECT doc_id, unnest(b) FROM p) SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id",
)
def _(t):
    half = F.floor(F.size("ws") / 2)
    halves = _ws(t).select("doc_id", A.head(F.col("ws"), half).alias("a"), A.drop(F.col("ws"), half).alias("b"))
    return halves.select("doc_id", F.size(F.array_except("a", "b")).cast("bigint").alias("n")).filter("n > 0")


@query(
    "jon06_broadcast_vocabulary",
    f"WITH {TOP_SQL} SELECT doc_id, count(*) AS n_known FROM (SELECT doc_id, unnest({words('text')}) AS token FROM documents) JOIN vocab USING (token) GROUP BY doc_id",
)
def _(t):
    placed = t.documents.select("doc_id", F.explode(T.split_words(F.col("text"))).alias("token"))
    return placed.join(_vocab(t).select("token"), "token").groupBy("doc_id").agg(F.count("*").alias("n_known"))


@query("srt01_most_frequent", f"WITH {TOP_SQL} SELECT token AS word, n FROM vocab WHERE id < 100")
def _(t):
    return V.word_frequencies(t.documents).orderBy(F.col("n").desc(), "word").limit(100)  # a top-k report


@query(
    "win06_until_budget",
    f"""WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS i FROM documents),
    r AS (SELECT doc_id, i, length(line) AS n, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY {h_hex("budget", "doc_id", "i")} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM raw)
    SELECT doc_id, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM r WHERE before < 200 GROUP BY doc_id""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.length("line"))
    w = Window.partitionBy("doc_id").orderBy(hash_hex("budget", "doc_id", "i")).rowsBetween(Window.unboundedPreceding, -1)
    kept = lines.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter("before < 200")
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_chars"))


for _number, _name in ((9, "bert-base"), (10, "bert-large")):

    @query(f"cor{_number:02d}_{_name.replace('-', '_')}", "SELECT doc_id, '' AS prompt, text FROM documents WHERE text <> ''")
    def _(t, name=_name):
        return C.CORPORA[name](t.documents)


@query("flt06_answerable_windows", f"SELECT label = 'N/A' AS missing, count(*) AS n FROM ({_passages_sql(True)}) GROUP BY 1")
def _(t):
    windows = Q.passage_windows(_qa(t), ["doc_id"], 400, answer_required=True)
    return windows.groupBy((F.col("label") == "N/A").alias("missing")).agg(F.count("*").alias("n"))


@query(
    "smp02_split_spec",
    """WITH e AS (SELECT count(*) * (949::DOUBLE / 950::DOUBLE) AS a, count(*) * (1::DOUBLE / 950::DOUBLE) AS b FROM documents)
    SELECT 'train' AS split, floor(a)::BIGINT AS n FROM e UNION ALL SELECT 'test', greatest(floor(floor(b) + ((a - floor(a)) + (b - floor(b)))), 1)::BIGINT FROM e""",
)
def _(t):
    shares = S.parse_split("949,50,1", has_valid=True)
    return S.split_rows(t.documents.select("doc_id"), ["doc_id"], shares).groupBy("split").agg(F.count("*").alias("n"))


@query("tsk26_extreme_summaries", f"WITH {BASE} SELECT 'dev-' || doc_id AS guid, text AS text_a, ls[1] AS text_b FROM base WHERE source = 'src3'")
def _(t):
    pairs = _base(t).select(F.col("doc_id").alias("line_no"), F.col("text").alias("source"), F.coalesce(F.col("ls")[0], F.lit("")).alias("target"), F.col("source").alias("list"))
    wanted = t.documents.filter("source = 'src3'").select(F.col("doc_id").alias("line_no"))
    return E.paired_texts(pairs.join(wanted, "line_no", "left_semi"), "dev").select("guid", "text_a", "text_b")


@query("tsk29_question_windows", f"SELECT label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM ({_passages_sql(False)}) GROUP BY label")
def _(t):
    windows = Q.passage_windows(_qa(t), ["doc_id"], 400)
    return windows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(
    "tsk32_custom_pairs",
    f"""WITH {TOKS} SELECT doc_id, {joined("[50002] || tokens[greatest(len(tokens) - 125, 0) + 1 :] || [50008, 50000]")} AS source FROM toks""",
)
def _(t):
    tokens = _tokens(t)
    one = lambda *xs: F.array(*map(F.lit, xs))
    return _show(tokens.select("doc_id", F.concat(one(SP.cls), A.tail(F.col("tokens"), 125), one(SP.smask, SP.eos)).alias("source")), "source")


@query(
    "tsk33_language_model_sets",
    f"""WITH c AS (SELECT trim(line) AS line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))
    SELECT count(*) AS n_docs, sum(length(line))::BIGINT AS n_tokens, sum(len(string_split(line, ' ')))::BIGINT AS n_original FROM c""",
)
def _(t):
    lines = t.documents.select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line"))
    return V.token_stats(lines.withColumn("tokens", encode_chars(F.col("line"))), "tokens", F.size(F.split("line", " ")))


@query(
    "prm33_chinese_question_source",
    f"""WITH s AS (SELECT doc_id, {codes("rtrim(text, ' ' || chr(10))")} AS src, {codes("'问题：' || source || '答案：'")} AS q FROM documents)
    SELECT doc_id, {joined("[50002] || q || [50003] || src[1 : 300 - len(q) - 2]")} AS source FROM s""",
)
def _(t):
    df = t.documents.select("doc_id", F.col("text").alias("text_a"), F.struct(F.col("source").alias("question")).alias("meta"))
    return _show(df.select("doc_id", source_tokens("cmrc", encode_chars, SP, 300).alias("source")), "source")


@query("ext01_text_hook", "SELECT doc_id, lower(text) AS text FROM documents WHERE length(text) > 100 AND lang = 'en'")
def _(t):
    return C.with_hook(C.web_text(t.documents), F.lower).select("doc_id", "text")
