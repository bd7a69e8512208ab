"""Text normalization rule sets as column expressions.

Every function maps a string column to a string column and stays inside the JVM. The replacement tables are applied top to
bottom, each rule seeing the output of the rule above it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters punctuation standardization maps to ASCII, and their targets.
CURLY_PUNCTUATION = "“”’‘–"
STRAIGHT_PUNCTUATION = "\"\"''-"

# Replacement rules of the Penn Treebank language-model set.
PTB_RULES = [
    (" '", "'"),
    (" \n", "\n"),
    ("\n ", "\n"),
    (" n't", "n't"),
    (" N ", "1 "),
    ("$ 1", "$1"),
    ("# 1", "#1"),
]

# Replacement rules of the WikiText language-model set, before and after its bracket rules.
WIKITEXT_RULES_BEFORE = [
    ("s '", "s'"),
    (" @-@ ", "-"),
    (" @,@ ", ","),
    (" @.@ ", "."),
    (" : ", ": "),
    (" ; ", "; "),
    (" . ", ". "),
    (" ! ", "! "),
    (" ? ", "? "),
    (" , ", ", "),
]
WIKITEXT_BRACKET_RULES = [
    (r"\(\s*([^\)]*?)\s*\)", "($1)"),
    (r"\[\s*([^\]]*?)\s*\]", "[$1]"),
    (r"\{\s*([^}]*?)\s*\}", "{$1}"),
    (r"\"\s*([^\"]*?)\s*\"", '"$1"'),
    (r"'\s*([^']*?)\s*'", "'$1'"),
]
WIKITEXT_RULES_AFTER = [
    ("= = = =", "===="),
    ("= = =", "==="),
    ("= =", "=="),
    (" ° ", "°"),
    (" \n", "\n"),
    ("\n ", "\n"),
    (" N ", " 1 "),
    (" 's", "'s"),
]

# Headline set (lower-case bracket codes, HTML entities).
HEADLINE_RULES = [
    ("UNK", "[UNK]"),
    ("<unk>", "[UNK]"),
    ("-lrb-", "("),
    ("-rrb-", ")"),
    ("-lsb-", "["),
    ("-rsb-", "]"),
    ("-lcb-", "{"),
    ("-rcb-", "}"),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]

# News set (upper-case bracket codes, quotes, clitics).
NEWS_RULES = [
    ("-LRB-", "("),
    ("-RRB-", ")"),
    ("-LSB-", "["),
    ("-RSB-", "]"),
    ("-LCB-", "{"),
    ("-RCB-", "}"),
    ("''", '"'),
    ("``", '"'),
    ("`", "'"),
    (" n't", "n't"),
    (" 's", "'s"),
    (" 'd", "'d"),
    (" 'll", "'ll"),
]
NEWS_SENTENCE_MARK = "<S_SEP>"

# Blank-filling set, on the way in and on the way out.
BLANK_RULES_IN = [("_UNK", "[UNK]"), ("<blank>", "[MASK]")]
BLANK_RULES_OUT = [
    ("` `", "``"),
    ("' '", "''"),
    ("n ' t", "n't"),
    ("' s", "'s"),
    ("' m", "'m"),
    ("' re", "'re"),
    (". . .", "..."),
    (" . .", " .."),
    ("- -", "--"),
    ("u . s .", "u.s."),
    ("u . k .", "u.k."),
    ("e . g .", "e.g."),
]

# Span-answer spacing patterns.
SPAN_ANSWER_RULES = [(" - ", "-"), (" – ", "–")]
SPAN_ANSWER_PATTERNS = [
    (r"\ba \. m \.\b", "a.m."),
    (r"\ba \. m\b", "a.m"),
    (r"\bp \. m \.\b", "p.m."),
    (r"\bp \. m\b", "p.m"),
    (r"\b' s\b", "'s"),
    (r"\bu \. s \.\b", "u.s."),
    (r"\bu \. s\b", "u.s"),
]

# Escapes cleaned in review files.
REVIEW_RULES = [("\\n", " "), ("\\", " ")]


def _accent_maps() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus marks, and those base letters."""
    accented, plain = [], []
    for code in range(0xC0, 0x2000):
        base = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != chr(code):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, UNACCENTED = _accent_maps()
# Latin letters that have no decomposition.
LATIN_SPELLINGS = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ð", "d"), ("ł", "l"), ("þ", "th")]

ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def replace_all(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def substitute_all(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def squeeze_spaces(text: Column) -> Column:
    """Words joined by single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def split_words(text: Column) -> Column:
    """Words between white space; a blank text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def standardize_punctuation(text: Column) -> Column:
    return replace_all(text, zip(CURLY_PUNCTUATION, STRAIGHT_PUNCTUATION))  # a text without such marks is only searched


def clean_spaces(text: Column) -> Column:
    """Collapse white space, then pull sentence dots to the word before them (three rounds)."""
    return replace_all(F.regexp_replace(text, r"(?U)\s+", " "), [(" . ", ". ")] * 3)


def detokenize_ptb(text: Column) -> Column:
    return replace_all(text, PTB_RULES)


def detokenize_wikitext(text: Column) -> Column:
    text = replace_all(text, WIKITEXT_RULES_BEFORE)
    return replace_all(substitute_all(text, WIKITEXT_BRACKET_RULES), WIKITEXT_RULES_AFTER)


def detokenize_headline(text: Column) -> Column:
    return replace_all(text, HEADLINE_RULES)


def detokenize_news(text: Column, is_target: bool = False) -> Column:
    mark = (NEWS_SENTENCE_MARK, "[SEP]" if is_target else "")
    return replace_all(text, [mark, *NEWS_RULES])


def blanks_in(text: Column) -> Column:
    return replace_all(text, BLANK_RULES_IN)


def blanks_out(text: Column) -> Column:
    return replace_all(text, BLANK_RULES_OUT)


def trim_field(text: Column, limit: int) -> Column:
    """Cut to `limit` characters and mark the cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("......"))).otherwise(text)


def strip_accents(text: Column) -> Column:
    """Remove combining marks, also those inside precomposed letters."""
    return F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), r"\p{Mn}", "")


def to_ascii(text: Column) -> Column:
    """ASCII spelling of Latin letters; other scripts stay as they are."""
    return replace_all(strip_accents(text), LATIN_SPELLINGS)


def normalize_answer(text: Column) -> Column:
    """Lower case, ASCII letters, no punctuation, no articles, single spaces."""
    text = F.regexp_replace(to_ascii(F.lower(text)), ASCII_PUNCTUATION, "")
    return squeeze_spaces(F.regexp_replace(text, r"\b(a|an|the)\b", " "))


def repair_span_answer(text: Column) -> Column:
    """Undo token spacing in a decoded answer, gluing numbers around , . and : again.

    A comma glues only when at most three characters follow, so it must be judged before anything to its right is glued.
    """
    text = squeeze_spaces(substitute_all(replace_all(text, SPAN_ANSWER_RULES), SPAN_ANSWER_PATTERNS))
    text = F.regexp_replace(text, r"(?<=\d) , (?=\d\S{0,2}(?:\s|$))", ",")
    return F.regexp_replace(text, r"(?<=\d) ([.:]) (?=\d)", "$1")


def clean_review(text: Column) -> Column:
    return replace_all(text, REVIEW_RULES)


def highlights_as_list(text: Column) -> Column:
    return F.replace(text, F.lit("@highlight\n"), F.lit("- "))


def strip_final_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[!-/:-@\[-`{-~]+\z", "")


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def sentences(text: Column, presplit: bool = False) -> Column:
    """Sentences of a text: its non-empty lines, each cut after . ? or ! unless the lines are sentences already."""
    lines = F.filter(F.split(text, "\n"), lambda line: line != "")
    if presplit:
        return lines
    return F.filter(F.flatten(F.transform(lines, lambda line: F.split(line, r"(?<=[.?!])\s+"))), lambda s: s != "")
