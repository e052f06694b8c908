"""Exact cuts: places in a text that no piece of a vocabulary can span."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: SentencePiece writes a space as this character.
SPACE = "▁"


#: ASCII signs and digits, as ranges, and one sign that vocabularies join with them.
SIGNS = r"!-@\[-`{-~²"
#: Stands between segments that are worked on together; a segment that holds it is worked on alone.
BREAK = "\x00"


def segment_pattern(pieces: Iterable[str]) -> re.Pattern[str] | None:
    """A pattern whose matches tile any text and are never crossed by a piece, or None if there is no such cut.

    Cuts lie before a run of SPACE, if no piece holds SPACE after another character; around line
    ends, if no piece of two or more characters holds one; and between SIGNS and other
    characters, if no piece holds both. Where a vocabulary has pieces that do cross such places,
    the text isn't cut there.
    """
    pieces = list(pieces)
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return None
    lines = "" if any("\n" in p for p in pieces if len(p) > 1) else "\n"
    bodies = [f"[^{SPACE}{lines}]+"]
    sign = re.compile(f"[{SIGNS}]")
    if not any(sign.search(p) and sign.sub("", p.lstrip(SPACE)) for p in pieces):
        bodies = [f"[{SIGNS}]+", f"[^{SIGNS}{SPACE}{lines}]+"]
    return re.compile("|".join([*(f"{SPACE}*{b}" for b in bodies), f"{SPACE}+", *(["\n"] if lines else [])]))


def together(segments: list[str]) -> Iterable[list[str]]:
    """Groups of segments to be worked on as one string, with BREAK after each."""
    yield [s for s in segments if BREAK not in s]
    yield from ([s] for s in segments if BREAK in s)
