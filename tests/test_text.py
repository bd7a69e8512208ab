"""Text rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from tokenmill.functions import text as T


def run(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("rule", "value", "expected"),
    [
        (T.standardize_punctuation, "“a” ‘b’ – c", "\"a\" 'b' - c"),
        (T.clean_spaces, "a \n\t b . c . d . e . f", "a b. c. d. e. f"),
        (T.detokenize_ptb, "it 's $ 1 N x\n y do n't", "it's $11 x\ny don't"),
        (T.detokenize_wikitext, "a @-@ b ( c ) \" d \" = = e = =", 'a-b (c) "d" == e =='),
        (T.detokenize_headline, "-lrb- UNK -rrb- &amp;", "( [UNK] ) &"),
        (T.detokenize_news, "`` do n't '' <S_SEP> -LRB-", "\" don't \"  ("),
        (T.blanks_out, "do n ' t . . . u . s .", "do n't ... u.s."),
        (lambda c: T.trim_field(c, 3), "abcd", "abc......"),
        (lambda c: T.trim_field(c, 3), "abc", "abc"),
        (T.normalize_answer, "The  Café, an OX-cart!", "cafe oxcart"),
        (T.normalize_answer, "Straße", "strasse"),
        (T.repair_span_answer, "1 , 234 . 5 - 6", "1,234.5-6"),
        (T.repair_span_answer, "in 1990 , 2000 : 30", "in 1990 , 2000:30"),
        (T.repair_span_answer, "1 , 2 , 3", "1,2,3"),
        (T.clean_review, "a\\nb\\c", "a b c"),
        (T.highlights_as_list, "x\n@highlight\ny", "x\n- y"),
        (T.strip_final_punctuation, "end?!", "end"),
        (T.strip_final_punctuation, "end.\n", "end.\n"),
        (T.lower_first, "", ""),
        (T.lower_first, "Ab", "ab"),
        (T.strip, "　 a b \n", "a b"),
    ],
)
def test_rules(spark, rule, value, expected):
    assert run(spark, rule, value) == expected


def test_sentences(spark):
    assert run(spark, T.sentences, "One. Two? Three\n\nFour!") == ["One.", "Two?", "Three", "Four!"]
    assert run(spark, lambda c: T.sentences(c, presplit=True), "One. Two?\nThree") == ["One. Two?", "Three"]
