"""Corpus projections, filters and normalization over `documents` and `conversations`.

Raw formats the tables lack (question/answer votes, encyclopedia fields, spaced tokens) are derived from them first.
"""

from pyspark.sql import functions as F

from tokenmill.functions import text as T
from tokenmill.operators import corpora as C
from tokenmill.operators.filters import drop_nulls, drop_redundant_sentences
from tokenmill.plans.registry import query
from tokenmill.plans.sqltext import codes, h_uniform, joined, words

STD = "translate({}, '“”’‘–', '\"\"''''-')"
CODE_POINTS = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))


@query("cor01_plain_text", "SELECT doc_id, '' AS prompt, text FROM documents")
def _(t):
    return C.plain_text(t.documents)


# Raw article: the words before each line's first sentence end are its key, the rest its content.
ARTICLE_SQL = """
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: l <> '') AS lines FROM documents),
article AS (SELECT doc_id,
  list_transform(lines, lambda l: regexp_extract(l, '^[^.]*')) AS key,
  list_transform(lines, lambda l: regexp_replace(l, '^[^.]*', '')) AS content FROM lines WHERE len(lines) > 0)"""


@query(
    "cor02_key_and_content",
    f"""WITH {ARTICLE_SQL},
    spaced AS (SELECT doc_id, list_transform(key, lambda k, i: CASE WHEN i = 1 THEN k ELSE ' ' || k END) AS key,
      list_transform(content, lambda c: ' ' || c) AS content FROM article)
    SELECT doc_id, 'summary' AS part, {joined("list_concat(" + codes("'Summary: '") + ", " + codes(STD.format("array_to_string(key, '')")) + ")")} AS tokens,
      '9 ' || length(array_to_string(key, ''))::VARCHAR AS runs FROM spaced
    UNION ALL
    SELECT doc_id, 'content',
      {joined("flatten(list_transform(list_zip(key, content), lambda p: list_concat(" + codes(STD.format("p[1]")) + ", " + codes(STD.format("p[2]")) + ", [50007])))")},
      {joined("flatten(list_transform(list_zip(key, content), lambda p: [length(p[1]), length(p[2]) + 1]))")} FROM spaced""",
)
def _(t):
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    article = t.documents.select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0).select(
        "doc_id",
        F.transform("lines", lambda line: F.regexp_extract(line, r"^[^.]*", 0)).alias("key"),
        F.transform("lines", lambda line: F.regexp_replace(line, r"^[^.]*", "")).alias("content"),
    )
    rows = C.prepare("wikipedia-key", article)
    return rows.select("doc_id", "part", F.array_join("tokens", " ").alias("tokens"), F.array_join("runs", " ").alias("runs"))


@query("cor03_web_text", "SELECT doc_id, '' AS prompt, text FROM documents WHERE length(text) > 100 AND lang = 'en'")
def _(t):
    return C.web_text(t.documents)


VOTES_SQL = """votes AS (SELECT doc_id, source AS title, text AS description, lang AS signature, text AS answer,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 1500)::VARCHAR END AS votes FROM documents)"""


def _votes(t):
    return t.documents.select(
        "doc_id",
        F.col("source").alias("q_title"),
        F.col("text").alias("q-content"),
        F.col("text").alias("ans-content"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.col("doc_id") % 1500).cast("string")).alias("ans-up-num"),
        F.col("lang").alias("user-signature"),
    )


TRIMMED = "CASE WHEN length({0}) > 100 THEN substr({0}, 1, 100) || '......' ELSE {0} END"


@query(
    "cor04_voted_answers",
    f"""WITH {VOTES_SQL} SELECT doc_id, '问题：' || title || '问题描述：' || {TRIMMED.format("description")} || '回答用户：' || signature || ' 回答：' AS prompt,
    answer AS text FROM votes WHERE length(answer) > 100 OR coalesce(try_cast(votes AS BIGINT), 0) > 1000""",
)
def _(t):
    return C.voted_answers(_votes(t))


@query(
    "cor05_best_and_other_answers",
    f"""WITH qa AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN source END AS title, text AS content,
      list_filter(string_split(text, chr(10)), lambda l: l <> '') AS lines FROM documents),
    answers AS (SELECT doc_id, title, content, list_concat(list_filter(lines[1:1], lambda a: length(a) > 10), list_filter(lines[2:], lambda a: length(a) > 100)) AS answers
      FROM qa WHERE title IS NOT NULL)
    SELECT doc_id, '问题：' || title || '问题描述：' || {TRIMMED.format("content")} || '回答：' AS prompt, (i - 1)::INTEGER AS answer_no, answers[i] AS text
    FROM answers, unnest(range(1, len(answers) + 1)) AS u(i)""",
)
def _(t):
    lines = t.documents.select("doc_id", "source", "text", F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"))
    return C.best_and_other_answers(lines.select(
        "doc_id",
        F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("title"),
        F.col("text").alias("content"),
        F.struct(F.try_element_at("lines", F.lit(1)).alias("content")).alias("best_answer"),
        F.transform(F.expr("slice(lines, 2, greatest(size(lines) - 1, 0))"), lambda x: F.struct(x.alias("content"))).alias("other_answers"),
    ))


@query(
    "cor06_encyclopedia",
    "SELECT doc_id, '' AS prompt, concat(CASE WHEN doc_id % 2 = 0 THEN source END, lang, text) AS text FROM documents",
)
def _(t):
    return C.encyclopedia(t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), F.col("lang").alias("abstract"), F.col("text").alias("content")))


@query(
    "cor07_prompt_text",
    """WITH turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text AS prompt, answer AS text FROM turns WHERE role = 'user' AND next_role = 'assistant'""",
)
def _(t):
    asked = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return C.prompt_text(asked.join(answered, ["conv_id", "turn"]), keys=("conv_id", "turn"))


@query(
    "cor08_line_documents",
    "SELECT doc_id, line_no::INTEGER - 1 AS line_no, '' AS prompt, lines[line_no] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(line_no) WHERE lines[line_no] <> ''",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return C.non_empty_text(lines, keys=("doc_id", "line_no"))


@query(
    "cor11_news",
    """WITH raw AS (SELECT doc_id, ' ' || source || ' ' AS title, CASE WHEN doc_id % 2 = 0 THEN text WHEN doc_id % 3 = 0 THEN ' ' || lang || ' ' END AS description,
      CASE WHEN doc_id % 5 > 0 THEN text END AS maintext FROM documents),
    glued AS (SELECT doc_id, trim(title) || ' ' || CASE WHEN coalesce(description, '') <> '' AND (coalesce(maintext, '') = '' OR NOT starts_with(maintext, description))
      THEN regexp_replace(description, '^\\s+|\\s+$', '', 'g') || ' ' ELSE '' END || coalesce(maintext, '') AS text FROM raw)
    SELECT doc_id, '' AS prompt, text FROM glued WHERE length(text) > 100""",
)
def _(t):
    return C.news(t.documents.select(
        "doc_id",
        F.concat(F.lit(" "), F.col("source"), F.lit(" ")).alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("text")).when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.col("lang"), F.lit(" "))).alias("description"),
        F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("maintext"),
    ))


@query(
    "cor12_mixed_sources",
    f"""SELECT doc_id, source, '' AS prompt, text FROM documents WHERE source NOT IN ('src0', 'src7') AND text <> ''
      AND (source NOT IN ('src3', 'src4', 'src5') OR {h_uniform("mixed", "doc_id")} <= 0.3)""",
)
def _(t):
    return C.mixed_sources(t.documents, dropped=("src0", "src7"), shares={"src3": 0.3, "src4": 0.3, "src5": 0.3})


@query("cor13_stories", "SELECT doc_id, '' AS prompt, text FROM documents WHERE text <> ''")
def _(t):
    return C.CORPORA["stories"](t.documents)


@query(
    "cor14_titled_text",
    "SELECT doc_id, '' AS prompt, source || ' ' || text AS text FROM documents WHERE length(source || ' ' || text) > 100",
)
def _(t):
    return C.titled_text(t.documents.select("doc_id", F.concat(F.lit("  "), F.col("source")).alias("title"), F.col("text").alias("content")))


@query(
    "agg02_source_token_totals",
    f"""SELECT lang, source, count(*) AS n_docs, sum(len({words("text")}))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars
    FROM documents WHERE length(text) > 100 AND source <> 'src0' GROUP BY lang, source""",
)
def _(t):
    kept = t.documents.filter(C.longer_than(F.col("text"), 100) & C.not_in_sources(F.col("source"), ["src0"]))
    text = T.standardize_punctuation(F.col("text"))
    return kept.groupBy("lang", "source").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size(T.split_words(text))).alias("n_words"),
        F.sum(F.length(text)).alias("n_chars"),
    )


@query("flt01_min_length", "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE length(text) > 100")
def _(t):
    return t.documents.filter(C.longer_than(F.col("text"), 100)).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("flt02_source_deny_list", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def _(t):
    return t.documents.filter(C.not_in_sources(F.col("source"), ["src1", "src2"])).select("doc_id", "source")


@query("flt03_language_keep", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def _(t):
    return t.documents.filter(C.in_language(F.col("lang"))).select("doc_id", "lang")


@query(
    "flt05_drop_nulls",
    "SELECT d.doc_id, d.text, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL",
)
def _(t):
    labels = t.labels.select("doc_id", "quality")
    return drop_nulls(t.documents.join(labels, "doc_id", "left").select("doc_id", "text", "quality"), ["text", "quality"])


@query("flt07_positive_only_for_training", "SELECT doc_id, quality FROM labels WHERE quality = 1")
def _(t):
    return t.labels.filter("quality = 1").select("doc_id", "quality")


@query(
    "flt08_votes_or_length",
    f"WITH {VOTES_SQL} SELECT doc_id, length(answer)::BIGINT AS n FROM votes WHERE length(answer) > 100 OR coalesce(try_cast(votes AS BIGINT), 0) > 1000",
)
def _(t):
    votes = _votes(t)
    kept = votes.filter(C.voted_or_long(F.col("ans-content"), F.col("ans-up-num")))
    return kept.select("doc_id", F.length("ans-content").cast("bigint").alias("n"))


@query(
    "flt09_redundant_sentences",
    f"""WITH raw AS (SELECT doc_id, unnest(range(len(lines)))::INTEGER AS pos, unnest(lines) AS sentence FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
    sents AS (SELECT *, list_distinct({words("lower(sentence)")}) AS ws FROM raw WHERE len({words("sentence")}) > 4),
    seen AS (SELECT doc_id, pos, w, min(pos) OVER (PARTITION BY doc_id, w) AS first_pos FROM (SELECT doc_id, pos, unnest(ws) AS w FROM sents)),
    share AS (SELECT doc_id, pos FROM seen GROUP BY doc_id, pos HAVING sum(CASE WHEN first_pos < pos THEN 1 ELSE 0 END) <= 0.7::DOUBLE * count(*))
    SELECT doc_id, pos, sentence FROM sents JOIN share USING (doc_id, pos)""",
)
def _(t):
    sents = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "sentence"))
    return drop_redundant_sentences(sents, "doc_id", rate=0.7)


def _spaced(c):
    """Token-spaced text with bracket codes and clitics, as detokenizers meet it."""
    c = F.regexp_replace(c, r"([.,!?:;()%-])", " $1 ")
    return T.replace_all(c, [(" of ", " -lrb- "), (" is ", " 's "), (" the ", " n't "), (" de ", " -LRB- "), (" la ", " @-@ "), (" and ", " `` "), (" un ", " = = ")])


def _spaced_sql(c):
    c = f"regexp_replace({c}, '([.,!?:;()%-])', ' \\1 ', 'g')"
    for a, b in [(" of ", " -lrb- "), (" is ", " ''s "), (" the ", " n''t "), (" de ", " -LRB- "), (" la ", " @-@ "), (" and ", " `` "), (" un ", " = = ")]:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _replace_sql(c, rules):
    for a, b in rules:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _regex_sql(c, rules):
    for a, b in rules:
        a, b = a.replace("'", "''"), b.replace("'", "''").replace("$1", "\\1")
        c = f"regexp_replace({c}, '{a}', '{b}', 'g')"
    return c


SPACED = _spaced_sql("text")
SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _rule_set(name, expression, sql):
    @query(name, f"SELECT doc_id, {sql} AS text FROM documents")
    def plan(t):
        return t.documents.select("doc_id", expression(F.col("text")).alias("text"))


_rule_set(
    "nrm01_standard_punctuation",
    lambda c: T.standardize_punctuation(F.translate(c, ".\"!", "’“–")),
    "translate(translate(text, '.\"!', '’“–'), '“”’‘–', '\"\"''''-')",
)
CURLY_SQL = "translate(text, '.\"!', '’“–')"


@query(
    "nrm01_prepared_corpora",
    f"""SELECT doc_id, 'stories' AS corpus, '' AS prompt, translate({CURLY_SQL}, '“”’‘–', '""''''-') AS text FROM documents WHERE text <> ''
    UNION ALL SELECT doc_id, 'wudao', '', source || ' ' || {CURLY_SQL} FROM documents WHERE length(source || ' ' || text) > 100""",
)
def _(t):
    curly = F.translate("text", ".\"!", "’“–")
    stories = C.prepare("stories", t.documents.select("doc_id", curly.alias("text")))
    titled = C.prepare("wudao", t.documents.select("doc_id", F.col("source").alias("title"), curly.alias("content")))
    return C.concat_corpora({"stories": stories, "wudao": titled}).select("doc_id", "corpus", "prompt", "text")


_rule_set("nrm02_clean_spaces", lambda c: T.clean_spaces(_spaced(c)), _replace_sql(f"regexp_replace({SPACED}, '\\s+', ' ', 'g')", [(" . ", ". ")] * 3))
_rule_set("nrm03_detokenize_ptb", lambda c: T.detokenize_ptb(_spaced(c)), _replace_sql(SPACED, T.PTB_RULES))
_rule_set(
    "nrm04_detokenize_wikitext",
    lambda c: T.detokenize_wikitext(_spaced(c)),
    _replace_sql(_regex_sql(_replace_sql(SPACED, T.WIKITEXT_RULES_BEFORE), T.WIKITEXT_BRACKET_RULES), T.WIKITEXT_RULES_AFTER),
)
_rule_set("nrm05_detokenize_headline", lambda c: T.detokenize_headline(_spaced(c)), _replace_sql(SPACED, T.HEADLINE_RULES))
_rule_set("nrm06_detokenize_news", lambda c: T.detokenize_news(_spaced(c), is_target=True), _replace_sql(SPACED, [("<S_SEP>", "[SEP]"), *T.NEWS_RULES]))
_rule_set(
    "nrm07_blank_filling",
    lambda c: T.blanks_out(T.blanks_in(F.replace(_spaced(c), F.lit(" in "), F.lit(" <blank> ")))),
    _replace_sql(_replace_sql(f"replace({SPACED}, ' in ', ' <blank> ')", T.BLANK_RULES_IN), T.BLANK_RULES_OUT),
)
_rule_set("nrm08_trim_field", lambda c: T.trim_field(c, 100), TRIMMED.format("text"))
_rule_set(
    "nrm09_normalize_answer",
    T.normalize_answer,
    SQUEEZE.format("regexp_replace(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[[:punct:]]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g')"),
)
_rule_set(
    "nrm10_repair_span_answer",
    lambda c: T.repair_span_answer(_spaced(c)),
    _regex_sql(
        SQUEEZE.format(_regex_sql(_replace_sql(SPACED, T.SPAN_ANSWER_RULES), T.SPAN_ANSWER_PATTERNS)),
        [(r"(\d) , (\d\S{0,2})(\s|$)", "$1,\\2\\3")] * 2 + [(r"(\d) ([.:]) (\d)", "$1\\2\\3")] * 2,
    ),
)
_rule_set("nrm11_clean_review", lambda c: T.clean_review(T.replace_all(c, [("\n", "\\n"), (",", "\\")])), "replace(replace(replace(replace(text, chr(10), '\\n'), ',', '\\'), '\\n', ' '), '\\', ' ')")
_rule_set("nrm12_highlights", lambda c: T.highlights_as_list(F.replace(c, F.lit("\n"), F.lit("\n@highlight\n"))), "replace(replace(text, chr(10), chr(10) || '@highlight' || chr(10)), '@highlight' || chr(10), '- ')")
