"""Texts cut into segments that tokenizers encode alone as within the text, so that each distinct one is encoded once.

A segment begins before a run of white space that starts with a blank or a line feed, and that follows no other
white space. Patterns that split at white space, and vocabularies without an entry that goes on from another
character into such a run, never look or merge across that place. `marks` also cuts between a Latin letter or
digit and a following ASCII sign, which holds for byte-level patterns that keep letters, digits and signs apart.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes

#: Distinct segments that a worker remembers.
CACHE = 1_000_000
#: Segments that the library gets at a time.
STEP = 20_000

_CODES = np.arange(256)
_BLANK = np.isin(_CODES, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_START = np.isin(_CODES, [10, 32])
_ALNUM = np.isin(_CODES, [ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
#: Signs before which letters and digits end; "|" is left out, as it stands inside the strings of special tokens.
_SIGN = np.isin(_CODES, [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"])
#: Second bytes of characters that may be white space, by what precedes the last byte; too many here only means fewer cuts.
_WIDE = {(0xE2, 0x80), (0xE2, 0x81), (0xE1, 0x9A), (0xE1, 0xA0), (0xE3, 0x80)}


def starts(raw: np.ndarray, first: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where segments begin in UTF-8 bytes; `first` has the places where rows begin."""
    before = np.empty_like(raw)
    before[:1], before[1:] = 32, raw[:-1]
    cut = _START[raw] & ~_BLANK[before]
    at = np.flatnonzero(cut & (before >= 0x80))
    if len(at):
        # After a character of two bytes or more: not if it may be white space itself.
        lead, mid = raw[at - 2], raw[np.maximum(at - 3, 0)]
        space = (lead == 0xC2) & ((raw[at - 1] == 0x85) | (raw[at - 1] == 0xA0))
        for a, b in _WIDE:
            space |= (mid == a) & (lead == b)
        cut[at[space]] = False
    if marks:
        sign = _SIGN[raw]
        cut |= sign & _ALNUM[before]
        at = np.flatnonzero(sign & (before >= 0x80))
        if len(at):
            letter = (raw[at - 2] == 0xC3) & (raw[at - 1] != 0x97) & (raw[at - 1] != 0xB7)
            cut[at[letter]] = True
    cut[first[first < len(raw)]] = True
    return np.flatnonzero(cut)


def split(texts: pa.Array, marks: bool = False, lead: str = "", whole: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All segments of all rows, and how many each row has; null and empty rows have none. `lead` comes before each row that is not empty; whole: a row is one segment."""
    if lead:
        texts = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(lead), texts, ""), pa.scalar(""))
    raw, offsets = text_bytes(texts)
    first = offsets[:-1][np.diff(offsets) > 0]
    at = first if whole else starts(raw, first, marks)
    edges = np.append(at, len(raw)).astype(np.int64)
    kind = pa.large_string()
    segments = pa.Array.from_buffers(kind, len(at), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
    return segments, np.diff(np.searchsorted(at, offsets))


def numbered(segments: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each segment, and the distinct segments by number."""
    found = segments.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


class Encoder:
    """Ids of whole texts by way of their segments; `encode` maps new segments to their ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], marks: bool) -> None:
        self._encode, self.marks = encode, marks
        self._forget()

    def _forget(self) -> None:
        """Known segments: their numbers; where their ids begin in the pool, and how many there are."""
        self.numbers: dict[str, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        sizes, pools = [], []
        for at in range(0, len(new), STEP):
            ids = self._encode(new[at : at + STEP])
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            pools.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, *pools])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each text has."""
        if len(self.numbers) > CACHE:
            self._forget()
        segments, per_row = split(texts, self.marks)
        own, distinct = numbered(segments)
        names, numbers = distinct.to_pylist(), self.numbers
        self._learn([s for s in names if s not in numbers])
        number = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))[own]
        size = self.size[number]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[number] - end + size, size) + np.arange(end[-1] if len(end) else 0)]
        edge = np.concatenate([[0], np.cumsum(per_row)])
        return ids, np.diff(np.concatenate([[0], end])[edge])


def library(path: str, plain: bool):
    """The tokenizers library's encoder; plain: strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    return tokenizer


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> Encoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary, without added special tokens; such strings within a text are special tokens, as by the library's default."""
    tokenizer = library(path, False)
    return Encoder(lambda some: [e.ids for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)], True)
