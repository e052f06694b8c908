"""Token counts under a unigram vocabulary, without making tokens.

A Viterbi pass over the matches that an Aho-Corasick automaton enumerates carries, for each
position, the best score and the number of pieces on the path that has it. Tie rules are the
tokenizer's: of equal scores the candidate with the earliest start stays, and a character that
is no piece costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import functools

import ahocorasick
from pyspark.sql import DataFrame

from .common import Memo, fanned_out, map_batches, text_or_empty
from .segments import BREAK, SPACE, segment_pattern, together

#: Fixed value: what an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, read as a unigram vocabulary.

    Control, unknown and byte pieces aren't among them: they never match text.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class UnigramCounter:
    """Best score and number of pieces of a text.

    A text is normalised as SentencePiece's identity rule does: a SPACE in front of a text that
    isn't empty, and SPACE for each space. Sums of the scores are in double precision.
    """

    def __init__(self, pieces: list[tuple[str, float]], memo_entries: int = 400_000):
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cut = segment_pattern(p for p, _ in pieces)
        self.memo = Memo(self.segments, memo_entries)
        if any(BREAK in p for p, _ in pieces):
            raise ValueError("a piece holds the character that separates segments")

    def segments(self, segments: list[str]) -> list[tuple[float, int]]:
        """Best score and number of pieces of each segment."""
        done: dict[str, tuple[float, int]] = {}
        for group in together(segments):
            alone = len(group) == 1 and BREAK in group[0]
            s = group[0] if alone else BREAK.join([*group, ""])
            score, count = self.paths(s, restart="" if alone else BREAK)
            if alone:
                done[s] = score[-1], count[-1]
            else:
                at = 0
                for g in group:
                    at += len(g)
                    done[g] = score[at], count[at]
                    at += 1
        return [done[s] for s in segments]

    def paths(self, s: str, restart: str) -> tuple[list[float], list[int]]:
        """Best score and its number of pieces up to each position, from 0 again after a `restart`."""
        n = len(s)
        matches: list = [()] * (n + 1)
        at, own = 0, []
        for end, match in self.automaton.iter(s):  # the longest first, so the earliest start
            if end != at:
                matches[at + 1], at, own = own, end, []
            own.append(match)
        matches[min(at + 1, n)] = own
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, pieces, length = None, 0, 0
            for length, own in matches[end]:
                candidate = score[end - length] + own
                if best is None or candidate > best:
                    best, pieces = candidate, count[end - length] + 1
            if length != 1:  # the character is no piece
                c = s[end - 1]
                if c == restart:
                    continue
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best:
                    best, pieces = candidate, count[end - 1] + len(c.encode())
            score[end], count[end] = best, pieces
        return score, count

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        text = SPACE + text.replace(" ", SPACE)
        found = self.memo.of(self.cut.findall(text) if self.cut else [text])
        return sum([x[0] for x in found]), sum([x[1] for x in found])


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary(path))


def token_counts(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens long, score double (of the best path) for every whole text.

    A null text counts as empty, which has 0 tokens and score 0. Texts of any length are counted
    whole. Keys are carried as they are (null and repeated ones too); other columns, whatever their
    names, are dropped. An empty table gives no rows. One narrow pass, no shuffle.
    """

    def make():
        counter = _counter(model_path)

        def apply(texts):
            got = [counter.count(t) for t in texts]
            return {"n_tokens": [n for _, n in got], "score": [s for s, _ in got]}

        return apply

    return map_batches(fanned_out(docs.select(key, text_or_empty(text).alias("text"))), make, "text", "n_tokens long, score double", (key,))
