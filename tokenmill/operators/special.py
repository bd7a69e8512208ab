"""Ids of the command tokens used when building training examples."""

from __future__ import annotations

from dataclasses import dataclass

from tokenmill.operators.vocab import command_rows


@dataclass(frozen=True)
class Special:
    pad: int
    eos: int
    sep: int
    cls: int
    mask: int
    unk: int
    sop: int
    eop: int
    gmask: int
    smask: int
    dblock: int
    sentinel_mask: tuple[int, ...] = ()
    sentinel_sop: tuple[int, ...] = ()


def special_tokens(text_size: int = 50_000, sentinels: int = 0) -> Special:
    """Ids behind a text vocabulary of the given size, in the layout of `command_rows`."""
    ids = {name: number for name, _, number in command_rows(text_size, sentinels=sentinels, fixed_ids=True)}
    return Special(
        pad=ids["pad"], eos=ids["eos"], sep=ids["sep"], cls=ids["ENC"], mask=ids["MASK"], unk=ids["unk"], sop=ids["sop"],
        eop=ids["eop"], gmask=ids["gMASK"], smask=ids["sMASK"], dblock=ids["dBLOCK"],
        sentinel_mask=(ids["MASK"], *(ids[f"MASK{i}"] for i in range(1, sentinels))),
        sentinel_sop=(ids["sop"], *(ids[f"sop{i}"] for i in range(1, sentinels))),
    )


# Code points of the characters that end a sentence, for character-level ids.
def end_ids(marks: str) -> list[int]:
    return [ord(mark) for mark in marks]
