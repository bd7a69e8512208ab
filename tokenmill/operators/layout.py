"""Token arrays to fixed-width model inputs. All layouts are row-local array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions import arrays as A
from tokenmill.operators.special import Special


def _one(value) -> Column:
    return F.array(value if isinstance(value, Column) else F.lit(value))


def _none() -> Column:
    return F.array().cast("array<int>")


def special_budget(has_b: Column, has_answer: Column, cls: bool = True, sep: bool = False, piece: bool = False, eos: bool = True) -> Column:
    """Number of special tokens a layout adds."""
    fixed = int(cls) + int(eos)
    return F.lit(fixed) + F.when(has_b & F.lit(sep), 1).otherwise(0) + F.when(~has_answer & F.lit(piece), 1).otherwise(0)


def build_input(
    df: DataFrame,
    special: Special,
    length: int,
    a: str = "tokens_a",
    b: str | None = "tokens_b",
    answer: str | None = None,
    add_cls: bool = True,
    add_sep: bool = False,
    add_piece: bool = False,
    add_eos: bool = True,
    mask_id: int | None = None,
    block_positions: bool = True,
    mask_position: int | None = None,
) -> DataFrame:
    """cls a [sep] b eos, and behind it `sop` and the answer without its last token.

    Positions of the answer repeat the last mask's position (or `mask_position`); block positions count inside the answer;
    targets hold the answer one step ahead, and only they carry loss. Everything is padded to `length`.
    """
    mask_id = special.mask if mask_id is None else mask_id
    b_tokens = F.coalesce(F.col(b), _none()) if b else _none()
    has_b = F.col(b).isNotNull() if b else F.lit(False)
    sep = F.when(has_b, _one(special.sep)).otherwise(_none()) if add_sep else _none()
    cls = _one(special.cls) if add_cls else _none()
    lead = F.concat(cls, F.col(a), sep)
    context = F.concat(lead, b_tokens)
    df = df.withColumns({"__c": context, "__t": F.concat(A.repeat(0, F.size(lead)), A.repeat(1, F.size(b_tokens))), "__end": has_b.cast("int")})
    capped = lambda c: F.when(F.size("__c") >= length - int(add_eos), A.head(F.col(c), length - 1)).otherwise(F.col(c))
    eos = _one(special.eos) if add_eos else _none()
    df = df.withColumns({"__c": F.concat(capped("__c"), eos), "__t": F.concat(capped("__t"), _one(F.col("__end")) if add_eos else _none())})
    df = df.withColumn("sep", F.size("__c"))
    at = F.lit(mask_position) if mask_position is not None else A.last_index(F.col("__c"), mask_id)
    has_piece = answer is not None or add_piece
    size = F.size(answer) if answer else F.lit(1 if has_piece else 0)
    shown = F.concat(_one(special.sop), A.head(F.col(answer), size - 1)) if answer else (_one(special.sop) if has_piece else _none())
    target = F.col(answer) if answer else (_one(0) if has_piece else _none())
    zeros = A.repeat(0, F.col("sep"))
    counted = A.counting(1, size) if block_positions else A.repeat(1, size)
    columns = {
        "ids": A.pad(F.concat("__c", shown), length, special.eos),
        "types": A.pad(F.concat("__t", A.repeat(F.col("__end"), size)), length, special.eos),
        "padding_mask": A.pad(A.repeat(1, F.col("sep") + size), length, 0),
        "position": A.pad(F.concat(A.counting(0, F.col("sep")), A.repeat(at, size)), length, 0),
        "block_position": A.pad(F.concat(zeros, counted), length, 0),
        "target": A.pad(F.concat(zeros, target), length, 0),
        "logit_mask": A.pad(F.concat(zeros, A.repeat(1, size)), length, 0),
    }
    return df.withColumns(columns).drop("__c", "__t", "__end")


def build_left_to_right(df: DataFrame, special: Special, length: int, a: str = "tokens_a", answer: str = "answer", add_cls: bool = True, mask_id: int | None = None) -> DataFrame:
    """cls mask, then `sop`, context and answer as one generated part; loss is on the answer."""
    mask_id = special.mask if mask_id is None else mask_id
    lead = (int(add_cls)) + 1
    ids = F.concat(*([_one(special.cls)] if add_cls else []), _one(mask_id), _one(special.sop), F.col(a), A.head(F.col(answer), F.size(answer) - 1))
    df = df.withColumns({"__i": ids, "sep": F.lit(lead)})
    generated = F.size("__i") - lead
    before = F.lit(lead) + F.size(a)
    return df.withColumns({
        "ids": A.pad(F.col("__i"), length, special.eos),
        "position": A.pad(F.concat(A.counting(0, F.lit(lead)), A.repeat(lead - 1, generated)), length, 0),
        "block_position": A.pad(F.concat(A.repeat(0, F.lit(lead)), A.counting(1, generated)), length, 0),
        "target": A.pad(F.concat(A.repeat(0, before), F.col(answer)), length, 0),
        "logit_mask": A.pad(F.concat(A.repeat(0, before), A.repeat(1, F.size(answer))), length, 0),
    }).drop("__i")


def build_decoder_input(df: DataFrame, special: Special, length: int, encoded: str = "ids", answer: str = "answer") -> DataFrame:
    """Answer side for scoring many answers of one shared context: `sop` and the answer, at the context's first mask."""
    size = F.size(answer)
    at = A.first_index(F.col(encoded), special.mask)
    return df.withColumns({
        "dec_ids": A.pad(F.concat(_one(special.sop), A.head(F.col(answer), size - 1)), length, special.eos),
        "dec_position": A.pad(A.repeat(at, size), length, 0),
        "dec_block_position": A.pad(A.counting(1, size), length, 0),
        "dec_target": A.pad(F.col(answer), length, 0),
        "dec_logit_mask": A.pad(A.repeat(1, size), length, 0),
    })


def pad_choices(df: DataFrame, batch: str, choices: str) -> DataFrame:
    """Give all rows of a batch as many choices as its widest row, repeating the first one; `choice_mask` marks real ones."""
    widest = F.max(F.size(choices)).over(Window.partitionBy(batch))
    missing = F.col("__widest") - F.size(choices)
    df = df.withColumn("__widest", widest)
    return df.withColumns({
        "choice_mask": F.concat(A.repeat(1, F.size(choices)), A.repeat(0, missing)),
        choices: F.concat(choices, F.array_repeat(F.get(choices, F.lit(0)), missing)),
    }).drop("__widest")


def sequence_pair_train(df: DataFrame, special: Special, source_length: int, target_length: int, source: str = "source", target: str = "target") -> DataFrame:
    """Fixed-width source, then `sop` and the target; the targets are the target tokens and `eop`."""
    closed = F.concat(target, _one(special.eop))
    src = A.fit(F.col(source), source_length, special.pad)
    at = F.greatest(A.first_index(F.col(source), special.mask), F.lit(0))
    df = df.withColumns({
        "__s": src, "__k": A.fit(closed, target_length, special.pad), "__at": at, "__n": F.least(F.size(closed), F.lit(target_length))})
    zeros = A.repeat(0, F.lit(source_length))
    return df.withColumns({
        "text": F.concat("__s", _one(special.sop), A.head(F.col("__k"), target_length - 1)),
        "target": F.concat(zeros, "__k"),
        "loss_mask": F.concat(zeros, A.pad(A.repeat(1, F.col("__n")), target_length, 0)),
        "position": F.concat(A.counting(0, F.lit(source_length)), A.repeat(F.col("__at"), F.lit(target_length))),
        "block_position": F.concat(zeros, A.counting(1, F.lit(target_length))),
        "sep": F.lit(source_length),
    }).drop("__s", "__k", "__at", "__n")


def sequence_pair_eval(df: DataFrame, special: Special, source_length: int, source: str = "source") -> DataFrame:
    """Fixed-width source and `sop`, ready for generation."""
    return df.withColumns({
        "text": F.concat(A.fit(F.col(source), source_length, special.pad), _one(special.sop)),
        "position": F.concat(A.counting(0, F.lit(source_length)), _one(F.greatest(A.first_index(F.col(source), special.mask), F.lit(0)))),
        "block_position": F.concat(A.repeat(0, F.lit(source_length)), _one(1)),
        "sep": F.lit(source_length),
    })


def shifted(tokens: Column, loss_mask: Column) -> Column:
    """Plain language modelling: all but the last token as input, all but the first as labels."""
    size = F.size(tokens)
    return F.struct(
        A.head(tokens, size - 1).alias("tokens"), A.drop(tokens, 1).alias("labels"), A.drop(loss_mask.cast("array<int>"), 1).alias("loss_mask"))


def gold_choice(choices: DataFrame, choice: str = "choice_no", label: str = "label") -> DataFrame:
    """The row of the right choice, for mixing scored choices into training."""
    return choices.filter(F.col(choice) == F.col(label).cast("int"))


def truncated_rows(df: DataFrame, sizes: Sequence[Column], special: Column, length: int) -> DataFrame:
    """How many rows do not fit, and how many there are."""
    total = special
    for size in sizes:
        total = total + size
    return df.agg(F.sum((total > length).cast("int")).cast("bigint").alias("n_truncated"), F.count("*").alias("n_rows"))
