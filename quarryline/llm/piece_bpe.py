"""SentencePiece BPE by a merge-type prefix table.

For each prefix of a segment the table stores the one token that ends the prefix's encoding.
Candidates are the vocabulary's matches that end there, from an Aho-Corasick automaton; the one
that holds is the one which is compatible with the last token of the prefix before it, that is,
whose pair with that token the merges leave as it is. Ids are then recovered backwards.
Segments are cut where no piece can reach across and are remembered, so a corpus pays for each
distinct segment about once.
"""

from __future__ import annotations

import functools
import hashlib
import math

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import Memo, fanned_out, map_batches, text_or_empty
from .segments import BREAK, segment_pattern, together


class PieceBpe:
    """Encoder for a SentencePiece BPE model with byte fallback; ids equal the library's."""

    def __init__(self, model_path: str, memo_entries: int = 400_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.ids, self.score, self.byte_ids = {}, {}, {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merges(list(piece)) == [piece]:  # else merging never ends in this piece
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.cut = segment_pattern(self.ids)
        self.unit = "<u2" if sp.get_piece_size() <= 1 << 16 else "<u4"
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo = Memo(self.segments_ids, memo_entries)
        if any(BREAK in p for p in self.ids):
            raise ValueError("a piece holds the character that separates segments")

    def merges(self, symbols: list[str]) -> list[str]:
        """Plain merging of a short list of symbols: best score first, leftmost among equals."""
        symbols, score, never = list(symbols), self.score.get, -math.inf
        scores = [score(a + b, never) for a, b in zip(symbols, symbols[1:], strict=False)]
        while scores and (best := max(scores)) > never:
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(symbols[i - 1] + symbols[i], never)
            if i < len(scores):
                scores[i] = score(symbols[i] + symbols[i + 1], never)
        return symbols

    def compatible(self, pair: tuple[str, str]) -> bool:
        """Whether merging leaves the two pieces of a pair apart; remembered."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        got = self.pairs[pair] = self.merges(list(pair[0] + pair[1])) == [*pair]
        return got

    def tokens(self, segment: str) -> list[str]:
        """The pieces of one segment; a character outside the vocabulary stands for itself."""
        last: list[str | None] = [None] * (len(segment) + 1)
        known, ids = self.pairs.get, self.ids
        for end, (length, piece) in self.automaton.iter(segment):
            end += 1
            if last[end] is not None:
                continue
            if length < end:
                before = last[end - length]
                if before is None:  # no piece ends there: an unknown character
                    before = segment[end - length - 1]
                fits = known((before, piece))
                if fits is None:
                    fits = before not in ids or self.compatible((before, piece))
                if not fits:
                    continue
            last[end] = piece
        out, at = [], len(segment)
        while at:
            piece = last[at] or segment[at - 1]
            out.append(piece)
            at -= len(piece)
        return out[::-1]

    def segments_ids(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, as unsigned little-endian integers of self.unit."""
        done: dict[str, bytes] = {}
        for group in together(segments):
            alone = len(group) == 1 and BREAK in group[0]
            own, at = [], 0
            for t in self.tokens(group[0] if alone else BREAK.join([*group, ""])):
                if t == BREAK and not alone:
                    done[group[at]] = np.array(own, self.unit).tobytes()
                    at, own = at + 1, []
                elif t in self.ids:
                    own.append(self.ids[t])
                else:
                    own.extend([self.byte_ids[b] for b in t.encode()])
            if alone:
                done[group[0]] = np.array(own, self.unit).tobytes()
        return [done[s] for s in segments]

    def encode(self, text: str) -> list[int]:
        text = self.library.normalize(text)
        found = self.memo.of(self.cut.findall(text) if self.cut else [text] * bool(text))
        return np.frombuffer(b"".join(found), self.unit).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.lru_cache(maxsize=2)
def _model(path: str) -> PieceBpe:
    return PieceBpe(path)


def piece_round_trip(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode the ids.

    Returns key, ids array<int>, decoded string. A null text counts as empty; an empty text has
    no ids and decodes to ''. Texts of any length are encoded whole. Keys are carried as they are
    (null and repeated ones too); other columns, whatever their names, are dropped. An empty table
    gives no rows. One narrow pass, no shuffle.
    """

    def make():
        model = _model(model_path)

        def apply(texts):
            ids = [model.encode(t) for t in texts]
            return {"ids": ids, "decoded": [model.decode(i) for i in ids]}

        return apply

    return map_batches(fanned_out(docs.select(key, text_or_empty(text).alias("text"))), make, "text", "ids array<int>, decoded string", (key,))


def piece_digests(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As piece_round_trip, but hashes in place of the ids and the text, made in the same pass.

    Returns key, n_tokens long, ids_sha256 (decimal ids joined by commas), decoded_sha256.
    """

    def make():
        model = _model(model_path)
        names = [str(i) for i in range(model.library.get_piece_size())]

        def apply(texts):
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = model.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            return out

        return apply

    return map_batches(fanned_out(docs.select(key, text_or_empty(text).alias("text"))), make, "text", "n_tokens long, ids_sha256 string, decoded_sha256 string", (key,))
