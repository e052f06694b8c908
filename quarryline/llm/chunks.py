"""Encodes whole batches of texts with the tokenizers library, each distinct chunk of text about once.

Where the tokenizer's own rules show that nothing is joined across white space, or from a letter
to a sign, texts are cut there; Arrow cuts and numbers the chunks of a batch, the library encodes
those that aren't known yet, and numpy puts the ids of all texts together.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo

#: The rules under which chunks are exact. White space becomes one space and is dropped
#: by the pattern, which parts letters from signs.
NORMALIZERS = {"NFC", "Replace", "Lowercase"}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A sign after a letter; the apostrophe isn't one, as it may join.
SIGN = r"([a-z])([.,;:!?&$%#*]+)"
ASCII_SIGN = r"[!-/:-@\[-`{-~]"
#: Marks that compose with letters before the letters become small ones.
MARKS = r"[\x{0300}-\x{036F}]"
#: Chunks that the library gets at once, and bytes of texts that are numbered at once (one text at least).
TOGETHER, SLICE = 2000, 8 << 20


def gathered(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches put together as long as their column of texts stays within SLICE bytes, so that fewer distinct chunks are looked up."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        more = batch.column(text).nbytes
        if held and size + more > SLICE:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.concat_batches(held)


def chunks_are_exact(rules: dict) -> bool:
    """Whether a tokenizer's rules (its JSON) never join what the chunks part."""
    normal, words = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal])
    space = [s for s in steps if s.get("type") == "Replace"]
    lower = any(s.get("type") == "Lowercase" for s in steps)
    split = (words.get("pretokenizers") or [words])[0]
    return (
        {s.get("type") for s in steps} == NORMALIZERS
        and lower
        and all(s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in space)
        and split.get("type") == "Split"
        and split.get("pattern") == {"Regex": PATTERN}
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and rules.get("post_processor") is None
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])
    )


class BatchEncoder:
    """Ids of whole texts, equal to those of the plain library call with add_special_tokens=False.

    Texts that hold an added token or combining marks go to the library whole, and so do all texts
    under rules that aren't known to allow chunks.
    """

    def __init__(self, path: str, memo_entries: int = 400_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.unit = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(self.library.to_str())
        self.exact = chunks_are_exact(rules)
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.between = next(((t["content"], t["id"]) for t in rules["added_tokens"] if t["special"]), None)
        self.last = self._word_ends(rules["model"])
        self.memo = Memo(self.chunks, memo_entries)

    def _word_ends(self, model: dict) -> np.ndarray | None:
        """For each id, whether it ends a word of letters; None for models that don't mark such ids."""
        suffix = model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not suffix or not re.search(ASCII_SIGN, suffix):  # which no word of letters spells
            return None
        ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, number in self.library.get_vocab(with_added_tokens=False).items():
            ends[number] = token.endswith(suffix)
        return ends

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.unit) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that hold no added token."""
        words = [c for c in chunks if c.isalpha()] if self.last is not None else []
        known = dict(zip(words, self._words(words), strict=True))
        rest = iter(self._parted([c for c in chunks if c not in known]))
        return [known[c] if c in known else next(rest) for c in chunks]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks of letters alone, with spaces between them: each ends at an id that ends a word.

        A chunk has at least one such id, so where there are as many as chunks each has one; where
        there are more (letters that the rules take apart) the chunks are parted otherwise.
        """
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            group = words[at : at + TOGETHER]
            (ids,) = self.whole([" ".join(group)])
            ends = np.flatnonzero(self.last[ids]) + 1
            out += self._cut(ids, [0, *ends[:-1]], ends) if len(ends) == len(group) else self._parted(group)
        return out

    def _parted(self, chunks: list[str]) -> list[bytes]:
        """Ids of any chunks. A special token between them shows where each ends."""
        if self.between is None:
            return [x.tobytes() for x in self.whole(chunks)]
        word, number = self.between
        out: list[bytes] = []
        for at in range(0, len(chunks), TOGETHER):
            (ids,) = self.whole([word.join(chunks[at : at + TOGETHER])])
            cuts = np.flatnonzero(ids == number)
            out += self._cut(ids, [0, *(cuts + 1)], [*cuts, len(ids)])
        return out

    def _cut(self, ids: np.ndarray, begins: Sequence[int], ends: Sequence[int]) -> list[bytes]:
        raw, size = ids.tobytes(), self.unit.itemsize
        return [raw[a:b] for a, b in zip((np.array(begins) * size).tolist(), (np.array(ends) * size).tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts without nulls, one text after the other, and the n + 1 places where texts begin and end."""
        if not len(texts):
            return np.empty(0, self.unit), np.zeros(1, np.int64)
        if not self.exact:
            return self._joined(self.whole(texts.to_pylist()))
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(sizes // SLICE, prepend=0))
        if len(texts) > 1 and len(cuts):
            cuts = [0, *[c for c in cuts.tolist() if c], len(texts)]
            parts = [self.encode(texts.slice(a, b - a)) if b - a < len(texts) else self._encode(texts) for a, b in zip(cuts, cuts[1:], strict=False)]
            shift = np.cumsum([0, *[len(ids) for ids, _ in parts]])
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *[ends[1:] + n for (_, ends), n in zip(parts, shift, strict=False)]]).astype(np.int64)
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lower = pc.ascii_lower(texts)
        odd = pc.match_substring_regex(lower, MARKS)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(lower, token.lower()))
        odd = odd.to_numpy(zero_copy_only=False)
        if odd.any():
            ids, ends = self.encode(texts.filter(pa.array(~odd)))
            plain = iter(np.split(ids, ends[1:-1])) if (~odd).any() else iter(())
            own = iter(self.whole(texts.filter(pa.array(odd)).to_pylist()))
            return self._joined([next(own if o else plain) for o in odd])
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, SIGN, r"\1 \2"))
        numbered = words.values.dictionary_encode()
        known = pa.array(self.memo.of(numbered.dictionary.to_pylist()), pa.large_binary()).take(numbered.indices)
        ends = np.frombuffer(known.buffers()[1], np.int64, len(known) + 1)
        ids = np.frombuffer(known.buffers()[2] or b"", self.unit)
        places = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids[: ends[-1] // self.unit.itemsize], ends[places] // self.unit.itemsize

    def _joined(self, own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.empty(0, self.unit), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> BatchEncoder:
    return BatchEncoder(path)
