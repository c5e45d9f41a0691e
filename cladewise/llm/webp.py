"""Lossless WebP media columns: a decoder of the whole lossless format, and an encoder to store payloads.

The decoder reads prefix codes (simple and normal, with groups by tile), back-references with the distance
map and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms; it
gives pixel arrays. Symbols are not read one by one: tables tell at once, for each bit, which token would begin
there and where it would end; the tokens are then followed from the first bit on, and copies and cached colours
are resolved together as pointers to earlier pixels. Only images of a few pixels are read symbol by symbol. Where
there are many files, their images are read side by side instead, a token of each at a time.

A payload is stored as the red, green and blue samples of an image 64 pixels wide (wider in steps of 64 where
the format's height ends), with fitted codes and back-references, and at least one transform: a palette where the
colours are few, else transforms, colour caches and groups of codes by tile as dealt by the payload's checksum, so
that a table has all parts of the format. Predictor modes and colour elements are fitted to each tile.

Defined results: null and empty text is a payload of blanks; equal texts are stored as equal bytes; repeated
rows have equal values; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, shared_folder, text_bytes

STEP = 192
WIDTH, MOST = 64, 1 << 14
# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The nearest places above and to the left, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


def _up(a: int, b: int) -> int:
    return -(-a // b)


# -- bits and codes ----------------------------------------------------------------------------------------

#: 16-bit numbers with their bits in reverse order.
_REVERSED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").reshape(-1).astype(np.int64)


class Reader:
    """Bits, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        #: Of the last code: the size of its alphabet, its bits, what they were, and the code.
        self.last: tuple[int, int, int, Code] | None = None

    def seen(self, n: int) -> int:
        """The next n bits, however many."""
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + (n >> 3) + 2], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image ends too early")
        out = self.peek(n)
        self.at += n
        return out

    @cached_property
    def words(self) -> memoryview:
        """At each byte it and the next seven, as one number; 64 more bytes of nothing at the end."""
        raw = self.data + bytes(72)
        return memoryview(np.ndarray(len(raw) - 8, np.uint64, raw, strides=(1,)).copy())

    @cached_property
    def triples(self) -> np.ndarray:
        """At each byte it and the next three, as one number; 16 more bytes of nothing at the end."""
        raw = np.frombuffer(self.data + bytes(20), np.uint8).astype(np.uint32)
        return raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)


class Writer:
    """Bits, least significant first, one at a time or as arrays of codes."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0
        self.parts: list[np.ndarray] = []

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def _flush(self) -> None:
        if self.n:
            self.parts.append(np.unpackbits(np.frombuffer(self.value.to_bytes(_up(self.n, 8), "little"), np.uint8), count=self.n, bitorder="little"))
            self.value, self.n = 0, 0

    def codes(self, values: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> None:
        """Each value with its size in bits."""
        self._flush()
        for at in range(0, len(values), step):
            value, size = values[at : at + step], sizes[at : at + step]
            end = np.cumsum(size)
            place = np.arange(end[-1], dtype=np.int32) - np.repeat((end - size).astype(np.int32), size)
            self.parts.append((np.repeat(value, size) >> place & 1).astype(np.uint8))

    def bytes(self) -> bytes:
        self._flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes() if self.parts else b""


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols in order of their codes, how much of the longest code's range each covers, their bits, and the longest one's. A single symbol takes no bits."""
    used = lengths.nonzero()[0]
    bits = lengths[used]
    if len(used) < 2:
        return np.zeros(1, np.int64) if not len(used) else used, np.ones(1, np.int64), np.zeros(1, np.int64), 0
    by = bits.argsort(kind="stable")
    used, bits = used[by], bits[by]
    wide = int(bits[-1])
    step = 1 << (wide - bits)
    if int(step.sum()) != 1 << wide:
        raise ValueError("a prefix code is not complete")
    return used, step, bits, wide


def stream_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its code as it lies in the stream, and its bits."""
    order, step, own, wide = canonical(lengths)
    out, bits = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
    if wide:
        out[order] = _REVERSED[step.cumsum() - step] >> (16 - wide)
        bits[order] = own
    return out, bits


@lru_cache(maxsize=4096)
def _small_stream_codes(lengths: tuple[int, ...]) -> tuple[list[int], list[int]]:
    codes, bits = stream_codes(np.array(lengths))
    return codes.tolist(), bits.tolist()


def all_stream_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """stream_codes() of each row."""
    bits = lengths.copy()
    bits[np.count_nonzero(bits, axis=1) < 2] = 0
    row, symbol = bits.nonzero()
    own = bits[row, symbol]
    by = np.argsort((row << 4) + own, kind="stable")
    row, symbol, own = row[by], symbol[by], own[by]
    # Complete codes cover the whole range of 16 bits, row by row.
    step = 1 << (16 - own)
    out = np.zeros_like(bits)
    out[row, symbol] = _REVERSED[step.cumsum() - step & 0xFFFF]
    return out, bits


class Code:
    """A prefix code, as a table over the next bits: symbol * 16 + bits."""

    def __init__(self, lengths: np.ndarray) -> None:
        order, step, bits, self.wide = canonical(lengths)
        self.table = (order << 4 | bits).astype(np.uint16)
        if self.wide:
            self.table = self.table.repeat(step)[_reversed(self.wide)]
        self.mask = np.uint32((1 << self.wide) - 1)

    @cached_property
    def entries(self) -> list[int]:
        return self.table.tolist()

    def read(self, r: Reader) -> int:
        x = self.entries[r.peek(self.wide)]
        r.at += x & 15
        return x >> 4


@lru_cache(maxsize=16)
def _reversed(wide: int) -> np.ndarray:
    return _REVERSED[: 1 << wide] >> (16 - wide)


@lru_cache(maxsize=1024)
def _simple(size: int, *symbols: int) -> Code:
    lengths = np.zeros(size, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


@lru_cache(maxsize=4096)
def _small(lengths: tuple[int, ...]) -> Code:
    """The codes of code lengths are few."""
    return Code(np.array(lengths))


#: Symbols of the code length code that stand for runs: the shortest, and the bits of what is added.
_RUNS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}


def read_code(r: Reader, size: int) -> Code:
    # The same bits for the same alphabet are the same code: red and blue often share theirs.
    begin = r.at
    if r.last is not None and r.last[0] == size and r.seen(r.last[1]) == r.last[2]:
        r.at += r.last[1]
        return r.last[3]
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        return _simple(size, *[r.bits(8 if wide else 1), *([r.bits(8)] if two else [])])
    n = 4 + r.bits(4)
    packed, own = r.bits(3 * n), [0] * 19
    for k in range(n):
        own[CODE_LENGTH_ORDER[k]] = packed >> 3 * k & 7
    code = _small(tuple(own))
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    words, entries, mask, bit = r.words, code.entries, (1 << code.wide) - 1, r.at
    lengths: list[int] = []
    before, note, open_ = 8, lengths.append, size
    try:
        while open_ > 0 and left:
            left -= 1
            w = words[bit >> 3] >> (bit & 7)
            x = entries[w & mask]
            n = x & 15
            if x < 256:
                bit += n
                x >>= 4
                note(x)
                open_ -= 1
                if x:
                    before = x
                continue
            base, more = _RUNS[x >> 4]
            k = base + (w >> n & (1 << more) - 1)
            lengths += [before if x < 272 else 0] * k
            open_ -= k
            bit += n + more
    except IndexError:
        raise ValueError("the image ends too early") from None
    r.at = bit
    if len(lengths) > size:
        raise ValueError("too many code lengths")
    if r.at > 8 * len(r.data):
        raise ValueError("the image ends too early")
    out, n, r.at = Code(np.array(lengths + [0] * (size - len(lengths)))), r.at - begin, begin
    r.last = size, n, r.seen(n), out
    r.at += n
    return out


#: Of each symbol of the code length code: the length it gives, how many at least, and the bits of what is added.
_GIVEN = np.append(np.arange(16), [0, 0, 0])
_AT_LEAST = np.append(np.ones(16, np.int64), [3, 3, 11])
_ADDED = np.append(np.zeros(16, np.int64), [2, 3, 7])


def _read_codes(readers: Sequence[Reader], sizes: Sequence[int], base: Sequence[int], words: np.ndarray) -> list[Code]:
    """read_code() of each: each step reads a length of every normal code that has not ended. base: where the readers' bytes begin in what words has."""
    out, many = [None] * len(readers), []
    for i, (r, size) in enumerate(zip(readers, sizes, strict=True)):
        first = r.seen(63)
        n = 4 + (first >> 1 & 15)
        # Simple codes, codes that only some symbols have, and the same bits again are read at once.
        if first & 1 or first >> 5 + 3 * n & 1 or r.last is not None and r.last[0] == size and r.seen(r.last[1]) == r.last[2]:
            out[i] = read_code(r, size)
        else:
            many.append((i, first >> 5, n))
    if len(many) < max(1, SIDES):
        for i, *_ in many:
            out[i] = read_code(readers[i], sizes[i])
        return out
    tables, held, masks, begin = [], [], [], []
    place = 0
    for i, packed, n in many:
        own = [0] * 19
        for k in range(n):
            own[CODE_LENGTH_ORDER[k]] = packed >> 3 * k & 7
        code = _small(tuple(own))
        tables.append(code.table)
        held.append(place)
        masks.append(len(code.table) - 1)
        begin.append(8 * base[i] + readers[i].at + 6 + 3 * n)
        place += len(code.table)
    table, held, mask, bit = np.concatenate(tables).astype(np.int64), np.array(held), np.array(masks), np.array(begin)
    size = np.array([sizes[i] for i, *_ in many])
    lane, at, before = np.arange(len(many)), np.zeros(len(many), np.int64), np.full(len(many), 8)
    notes: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        for _ in range(8):  # what is read behind a code's end is left out
            w = words[bit >> 3] >> (bit & 7)
            x = table[held + (w & mask)]
            symbol, n = x >> 4, x & 15
            more = _ADDED[symbol]
            count = _AT_LEAST[symbol] + (w >> n & (1 << more) - 1)
            given = np.where(symbol == 16, before, _GIVEN[symbol])
            before = np.where(symbol < 16, np.where(symbol > 0, symbol, before), before)
            bit = bit + n + more
            notes.append((lane, at, given, count, bit))
            at = at + count
        left = np.flatnonzero(at < size[lane])
        if len(left) < len(lane):
            lane, at, before, bit, held, mask = (c[left] for c in (lane, at, before, bit, held, mask))
        if len(bit) and int(bit.max()) >> 3 > len(words) - 64:
            raise ValueError("the image ends too early")
    lane, at, given, count, bit = (np.concatenate(c) for c in zip(*notes, strict=True))
    good = at < size[lane]
    lane, at, given, count, bit = (c[good] for c in (lane, at, given, count, bit))
    if (at + count > size[lane]).any():
        raise ValueError("too many code lengths")
    end = np.zeros(len(many), np.int64)
    np.maximum.at(end, lane, bit)
    some = np.flatnonzero(given)
    n, wide = count[some], int(size.max())
    lengths = np.zeros((len(many), wide), np.int64)
    lengths.reshape(-1)[np.repeat(lane[some] * wide + at[some] - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(given[some], n)
    for k, (i, *_) in enumerate(many):
        r = readers[i]
        n = int(end[k]) - 8 * base[i] - r.at
        if r.at + n > 8 * len(r.data):
            raise ValueError("the image ends too early")
        out[i] = Code(lengths[k, : sizes[i]])
        r.last = sizes[i], n, r.seen(n), out[i]
        r.at += n
    return out


#: Tokens of code lengths: a length, or 19 and more for the runs of symbols 17 and 18. Each one's symbol, what is added, and its bits.
_TOKENS = [(k, 0, 0) for k in range(19)] + [(17, k, 3) for k in range(8)] + [(18, k, 7) for k in range(128)]


@lru_cache(maxsize=4096)
def _zeros(n: int) -> list[int]:
    """A run of n lengths of 0 as tokens."""
    out = []
    while n >= 11:
        k = min(n, 138)
        out.append(27 + k - 11)
        n -= k
    return out + ([19 + n - 3] if n >= 3 else [0] * n)


def write_code(w: Writer, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the lengths of a code fitted to the counts; its stream_codes()."""
    return stream_codes(write_lengths(w, count))


def write_lengths(w: Writer, count: np.ndarray) -> np.ndarray:
    """Writes the lengths of a code fitted to the counts, and gives them."""
    used = count.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        for value, n in ((1, 1), (len(symbols) == 2, 1), (1, 1), *((s, 8) for s in symbols)):
            w.bits(value, n)
        lengths = np.zeros(len(count), np.int64)
        lengths[used] = 1
        return lengths
    lengths = fitted(count)
    tokens: list[int] = []
    note, place = tokens.append, 0
    for k, x in zip(used.tolist(), lengths[used].tolist(), strict=True):
        if k > place:
            tokens += _zeros(k - place)
        note(x)
        place = k + 1
    tokens += _zeros(len(count) - place)
    met = sorted(set(tokens))
    often = np.bincount(tokens).tolist()
    uses = [0] * 19
    for t in met:
        uses[_TOKENS[t][0]] += often[t]
    own = fitted(np.array(uses), 7)
    own = own.tolist()
    codes, bits = _small_stream_codes(tuple(own))
    n = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    value, at = (n - 4) << 1, 5  # a normal code
    for k in range(n):
        value |= own[CODE_LENGTH_ORDER[k]] << at
        at += 3
    at += 1  # lengths for the whole alphabet
    text = {}
    for t in met:
        k, more, extra = _TOKENS[t]
        text[t] = format(codes[k] | more << bits[k], f"0{bits[k] + extra}b") if bits[k] + extra else ""
    # The first token's bits are the lowest.
    tokens.reverse()
    all_bits = "".join([text[t] for t in tokens])
    w.bits(value | (int(all_bits, 2) if all_bits else 0) << at, at + len(all_bits))
    return lengths


def fitted(count: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for the counts; rare symbols count for more until the longest code fits."""
    lengths = np.zeros(len(count), np.int64)
    used = count.nonzero()[0]
    n, floor = len(used), 1
    if n < 2:
        lengths[used] = 1
        return lengths
    used = used[count[used].argsort(kind="stable")]
    ascending = count[used].tolist()
    endless = sum(ascending) * 2 + (n << 20)
    while True:
        leaf = [c if c > floor else floor for c in ascending] + [endless, endless]
        inner, parent = [endless] * (n + 1), [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):  # leaves and sums both come in ascending order
            if leaf[i] <= inner[j]:
                total, parent[i], i = leaf[i], n + k, i + 1
            else:
                total, parent[n + j], j = inner[j], n + k, j + 1
            if leaf[i] <= inner[j]:
                total, parent[i], i = total + leaf[i], n + k, i + 1
            else:
                total, parent[n + j], j = total + inner[j], n + k, j + 1
            inner[k] = total
        depth = [0] * (2 * n - 1)
        for x in range(2 * n - 3, -1, -1):
            depth[x] = depth[parent[x]] + 1
        if depth[0] <= most:  # the rarest symbol lies deepest
            lengths[used] = depth[:n]
            return lengths
        floor *= 2


# -- images of entropy-coded pixels ------------------------------------------------------------------------


def _number(r: Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes, extra values and extra bits of numbers from 1 on."""
    value = value.astype(np.int64) - 1
    high = np.maximum(np.frexp(value.astype(float))[1] - 1, 1).astype(np.int64)
    small, extra = value < 4, high - 1
    return np.where(small, value, 2 * high + (value >> extra & 1)), np.where(small, 0, value & (1 << extra) - 1), np.where(small, 0, extra)


def _sizes(cache_bits: int) -> tuple[int, ...]:
    """Of the alphabets of a group of codes."""
    return 256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40


def _near(d: int, width: int) -> int:
    if d > len(NEAR):
        return d - len(NEAR)
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


@lru_cache(maxsize=64)
def _near_distances(width: int) -> np.ndarray:
    return np.array([_near(d, width) for d in range(1, len(NEAR) + 1)])


#: Images of fewer pixels are read symbol by symbol.
FEW = 64
#: Bits whose tables are looked up at a time.
SPAN = 1 << 18


def read_pixels(r: Reader, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB words, in rows. top: the image itself, whose codes may differ by tile."""
    if top or width * height > SAME:
        return _read(r, *_image_codes(r, width, height, top))
    # Images of a few tiles are often the same: the same bits are the same pixels.
    key, begin = (width, height, r.peek(48)), r.at
    for n, bits, pixels in _SEEN.get(key, ()):
        if begin + n <= 8 * len(r.data) and r.seen(n) == bits:
            r.at += n
            return pixels
    pixels = _read(r, *_image_codes(r, width, height, False))
    pixels.flags.writeable = False
    n, r.at = r.at - begin, begin
    if len(_SEEN) >= 4096:
        _SEEN.clear()
    _SEEN[key] = (*_SEEN.get(key, ())[-7:], (n, r.seen(n), pixels))
    r.at += n
    return pixels


#: Pixels of images whose bits are kept for the next image like it, and such images by size and first bits.
SAME = 16
_SEEN: dict[tuple[int, int, int], tuple[tuple[int, int, np.ndarray], ...]] = {}


def _read(r: Reader, codes: list[list[Code]], group_of: np.ndarray | None, width: int, total: int, cache_bits: int) -> np.ndarray:
    return (_one_by_one if total < FEW else _by_tables)(r, codes, group_of, width, total, cache_bits)


def _image_codes(r: Reader, width: int, height: int, top: bool) -> tuple[list[list[Code]], np.ndarray | None, int, int, int]:
    """What stands before an image's tokens: groups of codes, each pixel's group, width, pixels, and bits of the cache."""
    groups, group_of, cache_bits = _image_head(r, width, height, top)
    return [[read_code(r, size) for size in _sizes(cache_bits)] for _ in range(groups)], group_of, width, width * height, cache_bits


def _image_head(r: Reader, width: int, height: int, top: bool) -> tuple[int, np.ndarray | None, int]:
    """How many groups of codes an image has, each pixel's group, and bits of the cache."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of = None
    total, groups = width * height, 1
    if top and r.bits(1):
        tile_bits = 2 + r.bits(3)
        across = _up(width, 1 << tile_bits)
        tiles = (read_pixels(r, across, _up(height, 1 << tile_bits), False) >> 8 & 0xFFFF).astype(np.int64)
        n = np.arange(total)
        group_of, groups = tiles[(n // width >> tile_bits) * across + (n % width >> tile_bits)], int(tiles.max()) + 1
    return groups, group_of, cache_bits


def _one_by_one(r: Reader, groups: list[list[Code]], group_of: np.ndarray | None, width: int, total: int, cache_bits: int) -> np.ndarray:
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    shift, at = 32 - cache_bits, 0
    green, red, blue, alpha, distance = groups[0]
    while at < total:
        if group_of is not None:
            green, red, blue, alpha, distance = groups[group_of[at]]
        s = green.read(r)
        n = 1
        if s < 256:
            low, low2 = red.read(r), blue.read(r)
            out[at] = alpha.read(r) << 24 | low << 16 | s << 8 | low2
        elif s < 280:
            n = _number(r, s - 256)
            d = _near(_number(r, distance.read(r)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):
                out[k] = out[k - d]
        else:
            out[at] = cache[s - 280]
        if r.at > 8 * len(r.data):
            raise ValueError("the image ends too early")
        if cache_bits:
            for k in range(at, at + n):
                cache[(CACHE_MULTIPLIER * out[k] & 0xFFFFFFFF) >> shift] = out[k]
        at += n
    return np.array(out, np.uint32)


class _Span:
    """What a token would be if it began at each of the next bits, for one group of codes: where it ends, how many pixels it gives."""

    def __init__(self, window: np.ndarray, n: int, codes: list[Code]) -> None:
        self.window, self.codes = window, codes
        green, red, blue, alpha, distance = codes
        self.green = green.table[window[:n] & green.mask]
        at = np.arange(n, dtype=np.int32) + (self.green & 15)
        self.after = end = at
        for code in (red, blue, alpha):
            if code.wide:
                end = end + (code.table[window[end] & code.mask] & 15)
        self.count = None
        if int(green.table.max()) >= 256 << 4:
            symbol = self.green >> 4
            self.count, self.distance = np.ones(n, np.int32), np.zeros(n, np.int32)
            end = np.where(symbol >= 280, at, end)
            copy = np.flatnonzero((symbol >= 256) & (symbol < 280))
            place = at[copy]
            self.count[copy], place = self._numbers(symbol[copy].astype(np.int32) - 256, place)
            entry = distance.table[window[place] & distance.mask].astype(np.int32)
            self.distance[copy], end[copy] = self._numbers(entry >> 4, place + (entry & 15))
        self.end = end

    def _numbers(self, prefix: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.maximum(prefix - 2, 0) >> 1
        more = (self.window[place] & ((1 << extra) - 1).astype(np.uint32)).astype(np.int32)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), place + extra

    def literals(self, at: np.ndarray) -> np.ndarray:
        """ARGB words of literals that begin there."""
        out, place = (self.green[at] >> 4).astype(np.uint32) << np.uint32(8), self.after[at]
        for code, shift in zip(self.codes[1:4], (16, 0, 24), strict=True):
            entry = code.table[self.window[place] & code.mask].astype(np.uint32)
            out |= entry >> np.uint32(4) << np.uint32(shift)
            place = place + (entry & np.uint32(15)).astype(np.int32)
        return out


def _walk(spans: list[_Span], group_of: np.ndarray | None, bit: int, bits: int, at: int, total: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Follows the tokens from a bit on: their bits and pixels, and the bit and pixel where it stops."""
    places: list[int] = []
    if group_of is not None:
        pixels: list[int] = []
        end, count = [memoryview(s.end) for s in spans], [memoryview(s.count) if s.count is not None else None for s in spans]
        own = memoryview(group_of)
        while bit < bits and at < total:
            places.append(bit)
            pixels.append(at)
            g = own[at]
            at += count[g][bit] if count[g] is not None else 1
            bit = end[g][bit]
        return np.array(places, np.int64), np.array(pixels, np.int64), bit, at
    span, left = spans[0], total - at
    if not any(code.wide for code in span.codes[:4]):  # one colour, without a bit
        return np.full(left, bit), np.arange(at, total), bit, total
    end, note = memoryview(span.end), places.append
    if span.count is None:
        for _ in range(left):
            if bit >= bits:
                break
            note(bit)
            bit = end[bit]
        place = np.array(places, np.int64)
        return place, at + np.arange(len(place)), bit, at + len(place)
    # Tokens past the last pixel are left out afterwards; an image has few bits behind it.
    for _ in range(left):
        if bit >= bits:
            break
        note(bit)
        bit = end[bit]
    place = np.array(places, np.int64)
    stop = at + span.count[place].cumsum(dtype=np.int64)
    n = min(int(np.searchsorted(stop, total)) + 1, len(place))
    last = int(stop[n - 1]) if n else at
    return place[:n], (stop - span.count[place])[:n], places[n] if n < len(places) else bit, last


def _roots(source: np.ndarray) -> np.ndarray:
    """Follows each pixel's source to a pixel that is its own."""
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return source
        source = further


def _by_tables(r: Reader, groups: list[list[Code]], group_of: np.ndarray | None, width: int, total: int, cache_bits: int) -> np.ndarray:
    """Looks up the token that begins at each bit, all at once, then follows the tokens; copies and cached colours are resolved as pointers to earlier pixels."""
    out, source = np.zeros(total, np.uint32), np.arange(total)
    slot, cached = np.zeros(total, np.int64), []
    near = _near_distances(width)
    at, margin = 0, 96
    while at < total:
        first, bits = r.at >> 3, min(SPAN, 8 * len(r.data) - (r.at & ~7) + 8)
        if r.at >= 8 * len(r.data) + 8:
            raise ValueError("the image ends too early")
        words = r.triples[first : first + (bits + margin >> 3)]
        words = np.concatenate([words, np.zeros((bits + margin >> 3) - len(words), np.uint32)])
        window = (words[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)
        # 25 bits of a window are sure to be there; no code or number takes more.
        spans = [_Span(window, bits, codes) for codes in groups]
        place, pixel, bit, stop = _walk(spans, group_of, r.at & 7, bits, at, total)
        for g, span in enumerate(spans):
            own = slice(None) if group_of is None else group_of[pixel] == g
            p, x = place[own], pixel[own]
            symbol = span.green[p] >> 4
            plain = symbol < 256
            out[x[plain]] = span.literals(p[plain])
            if plain.all():
                continue
            copy = (symbol >= 256) & (symbol < 280)
            n, d, start = span.count[p[copy]].astype(np.int64), span.distance[p[copy]].astype(np.int64), x[copy]
            d = np.where(d > len(NEAR), d - len(NEAR), near[np.minimum(d, len(NEAR)) - 1])
            if (d > start).any() or (start + n > total).any():
                raise ValueError("a back-reference leaves the image")
            target = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
            source[target] = target - np.repeat(d, n)
            hit = symbol >= 280
            slot[x[hit]] = symbol[hit].astype(np.int64) - 280
            cached.append(x[hit])
        at, r.at = stop, (r.at & ~7) + bit
    if r.at > 8 * len(r.data):
        raise ValueError("the image ends too early")
    root = _roots(source)
    hits = np.concatenate(cached) if cached else np.zeros(0, np.int64)
    if len(hits):
        known = np.ones(total, bool)
        known[hits] = False
        slot[known] = ((out[known] * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        slot = slot[root]
        # A cached colour is that of the last pixel before with the same place in the cache; at first all are 0.
        order = np.argsort(slot, kind="stable")
        same = slot[order[1:]] == slot[order[:-1]]
        before = np.arange(total)
        before[order[1:][same]] = order[:-1][same]
        source[hits] = before[hits]
        root = _roots(source)
    return out[root]


#: Of each green symbol, and of 256 + each prefix of a distance: 0 a literal, 1 a copy, 2 a cached colour; the least number of a prefix, and the bits of what is added.
_KIND = np.repeat([0, 1, 2], [256, 24, 1 << 11])
_MORE = np.concatenate([np.zeros(256, np.int64), np.maximum(np.arange(40) - 2, 0) >> 1, np.zeros(1 << 11, np.int64)])
_LEAST = np.concatenate([np.ones(256, np.int64), np.where(np.arange(40) < 4, np.arange(40) + 1, ((2 + (np.arange(40) & 1)) << _MORE[256:296]) + 1), np.ones(1 << 11, np.int64)])
#: Tokens between two looks at which images have ended, and images that are read side by side at least.
STRIDE, SIDES = 16, 32


def _side_by_side(images: list[tuple[Reader, list[list[Code]], np.ndarray | None, int, int, int]]) -> list[np.ndarray]:
    """Pixels of images whose alpha has no bits, the same in all groups of codes: each step reads a token of every image that has not ended."""
    n = len(images)
    total, cache_bits = (np.array([x[k] for x in images]) for k in (4, 5))
    size = np.array([len(x[0].data) for x in images])
    gap = STRIDE * 16  # steps behind an image's end read into the next one's bytes, and are left out
    raw = b"".join(x[0].data for x in images) + bytes(gap)
    words = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,)).astype(np.int64)
    words &= (1 << 62) - 1
    begin = np.cumsum(size) - size
    # Entries: symbol * 256 + bits of the code and of what is added. The first is a table of one symbol without bits.
    sets = [codes for x in images for codes in x[1]]
    groups = np.array([len(x[1]) for x in images])
    first_set = np.cumsum(groups) - groups
    tables, held, masks = [np.zeros(1, np.int32)], np.zeros((len(sets), 4), np.int64), np.zeros((len(sets), 4), np.int64)
    # The set of each pixel of images with tiles; of others, one number for all their pixels.
    by_pixel = [x[2] is not None for x in images]
    set_of = np.concatenate([x[2] + k if x[2] is not None else np.full(1, k) for x, k in zip(images, first_set, strict=True)])
    set_at = np.cumsum(np.where(by_pixel, total, 1)) - np.where(by_pixel, total, 1)
    set_step = np.where(by_pixel, total - 1, 0)
    place = 1
    for i, codes in enumerate(sets):
        for k, code in enumerate((codes[0], codes[1], codes[2], codes[4])):
            symbol = code.table.astype(np.int32) >> 4
            entry = symbol << 8 | (code.table & 15)
            if k in (0, 3):
                entry += np.where(symbol < 280, _MORE[symbol], 0).astype(np.int32) if k == 0 else _MORE[256 + symbol].astype(np.int32)
            held[i, k], masks[i, k] = place, len(entry) - 1
            tables.append(entry)
            place += len(entry)
    table = np.concatenate(tables)
    zero = np.zeros(len(sets), np.int64)
    # By set and kind of token: what follows green, and what follows that.
    then, then_mask = (np.stack([x[:, 1], x[:, 3], zero], axis=1).reshape(-1) for x in (held, masks))
    last, last_mask = (np.stack([x[:, 2], zero, zero], axis=1).reshape(-1) for x in (held, masks))
    lane = np.argsort(-total, kind="stable")
    bit, at = (8 * begin + [x[0].at for x in images])[lane], np.zeros(n, np.int64)
    notes: list[tuple[np.ndarray, ...]] = []
    while len(lane):
        one, begins, most = set_of[set_at[lane]], set_at[lane], set_step[lane]
        tiled = most.any()
        green, green_mask, three = held[one, 0], masks[one, 0], 3 * one
        for _ in range(STRIDE):
            if tiled:
                one = set_of[begins + np.minimum(at, most)]
                green, green_mask, three = held[one, 0], masks[one, 0], 3 * one
            w = words[bit >> 3] >> (bit & 7)
            x = table[green + (w & green_mask)]
            symbol, step = x >> 8, x & 255
            kind = _KIND[symbol]
            of = three + kind
            length = None
            copy = (kind == 1).nonzero()[0]
            if len(copy):
                s = symbol[copy]
                length = _LEAST[s] + (w[copy] >> (step[copy] - _MORE[s]) & (1 << _MORE[s]) - 1)
            w >>= step
            y = table[then[of] + (w & then_mask[of])]
            w >>= y & 255
            z = table[last[of] + (w & last_mask[of])]
            notes.append((lane, at, bit, x, y, z))
            bit = bit + step + (y & 255) + (z & 255)
            at = at + 1
            if length is not None:
                at[copy] += length - 1
        left = (at < total[lane]).nonzero()[0]
        if len(left) < len(lane):
            lane, at, bit = lane[left], at[left], bit[left]
        if (bit > 8 * (begin + size)[lane]).any():
            raise ValueError("the image ends too early")
    lane, at, bit, x, y, z = (np.concatenate(c) for c in zip(*notes, strict=True))
    good = (at < total[lane]).nonzero()[0]
    lane, at, bit, x, y, z = (c[good] for c in (lane, at, bit, x, y, z))
    if (bit + (x & 255) + (y & 255) + (z & 255) > 8 * (begin + size)[lane]).any():
        raise ValueError("the image ends too early")
    first = np.cumsum(total) - total
    pixel, symbol = first[lane] + at, x >> 8
    every = int(total.sum())
    alpha = np.array([int(c[1][0][3].table[0]) >> 4 << 24 for c in images], np.int64)
    out, source = np.zeros(every, np.uint32), np.arange(every)
    kind = _KIND[symbol]
    plain, copy, hit = ((kind == k).nonzero()[0] for k in range(3))
    out[pixel[plain]] = alpha[lane[plain]] | (y[plain] >> 8).astype(np.int64) << 16 | symbol[plain] << 8 | z[plain] >> 8
    if len(copy):
        near = np.stack([_near_distances(c[3]) for c in images])
        own, bits = lane[copy], bit[copy]
        w = words[bits >> 3] >> (bits & 7)
        k = (x[copy] & 255) - _MORE[symbol[copy]]
        length = _LEAST[symbol[copy]] + (w >> k & (1 << _MORE[symbol[copy]]) - 1)
        prefix = 256 + (y[copy] >> 8)
        bits = bits + (x[copy] & 255) + (y[copy] & 255) - _MORE[prefix]
        d = _LEAST[prefix] + (words[bits >> 3] >> (bits & 7) & (1 << _MORE[prefix]) - 1)
        d = np.where(d > len(NEAR), d - len(NEAR), near[own, np.minimum(d, len(NEAR)) - 1])
        if (d > at[copy]).any() or (at[copy] + length > total[own]).any():
            raise ValueError("a back-reference leaves the image")
        target = np.repeat(pixel[copy] - np.cumsum(length) + length, length) + np.arange(length.sum())
        source[target] = target - np.repeat(d, length)
    root = _roots(source)
    if len(hit):
        hits = pixel[hit]
        some = np.repeat(cache_bits > 0, total).nonzero()[0]
        image = np.repeat(np.arange(n), total)[some]
        slot = np.zeros(every, np.int64)
        slot[some] = (out[some] * np.uint32(CACHE_MULTIPLIER)).astype(np.int64) >> (32 - cache_bits[image])
        slot[hits] = symbol[hit] - 280
        slot = slot[root[some]] + (image << 11)
        # As in _by_tables(): the last pixel before with the same place in the image's cache.
        order = _in_order(slot)
        same = slot[order[1:]] == slot[order[:-1]]
        before = np.full(every, -1)
        before[some[order[1:][same]]] = some[order[:-1][same]]
        none = hits[before[hits] < 0]
        before[none] = none
        source[hits] = before[hits]
        root = _roots(source)
    return np.split(out[root], first[1:])


#: Bits of a place in one number with what it is sorted by.
PLACE = 24


def _in_order(key: np.ndarray) -> np.ndarray:
    """np.argsort(key, kind="stable") of numbers below 2**40; sorting whole numbers takes less time."""
    if len(key) > 1 << PLACE:
        return np.argsort(key, kind="stable")
    both = key.astype(np.uint64) << np.uint64(PLACE)
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << PLACE) - 1)
    return both.view(np.int64)


def _repeats(argb: np.ndarray, image: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Back-references (pixel, length, distance), from left to right: runs of pixels whose next three last stood at one distance. image: of several images in a row, each pixel's."""
    n = len(argb) - 2
    if n < 2:
        return []
    wide = argb.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (wide[2:] * np.uint64(0x165667B19E3779F9))
    # Places of equal pixels in several images come image by image.
    key >>= np.uint64(PLACE)
    order = _in_order(key)
    key = key[order]
    near = np.flatnonzero(key[:-1] == key[1:])
    a, b = order[near], order[near + 1]
    same = (argb[a] == argb[b]) & (argb[a + 1] == argb[b + 1]) & (argb[a + 2] == argb[b + 2])
    if image is not None:
        same &= (image[a] == image[b + 2]) & (image[a] == image[a + 2])
    distance = np.zeros(n, np.int64)
    distance[b[same]] = (b - a)[same]
    edge = np.flatnonzero(np.diff(distance, prepend=0, append=0))
    d = distance[edge[:-1]]
    some = np.flatnonzero(d)
    out, at = [], 0
    for first, stop, d in zip(edge[:-1][some].tolist(), edge[1:][some].tolist(), d[some].tolist(), strict=True):
        first = max(first, at)
        if first >= stop:
            continue
        left = stop + 2 - first
        while left >= 3:
            k = min(left, 4096)
            out.append((first, k, d))
            first, left = first + k, left - k
        at = first
    return out


@lru_cache(maxsize=8)
def _near_codes(width: int) -> np.ndarray:
    """The code of each short distance, or 0."""
    out = np.zeros(8 * width + 9, np.int64)
    for k in range(len(NEAR), 0, -1):
        out[_near(k, width)] = k
    return out


def _tile_groups(tiles: int) -> np.ndarray:
    """The image of tiles' groups, which take turns."""
    return (np.arange(tiles) % 2 * 256 + 0xFF000000).astype(np.uint32)


def _write_plain(w: Writer, argb: np.ndarray) -> None:
    """write_pixels() of literals only. Images of a few tiles are often the same."""
    if len(argb) > SAME:
        _write_literals(w, argb)
    else:
        w.bits(*_small_plain(argb.tobytes()))


@lru_cache(maxsize=4096)
def _small_plain(argb: bytes) -> tuple[int, int]:
    w = Writer()
    _write_literals(w, np.frombuffer(argb, np.uint32))
    raw, n = w.bytes(), sum(map(len, w.parts))
    return int.from_bytes(raw, "little"), n


def _write_literals(w: Writer, argb: np.ndarray) -> None:
    w.bits(0, 1)
    blue, green, red, alpha = _channels(argb).T
    shared = np.bincount(red, minlength=256) + np.bincount(blue, minlength=256)  # as in write_pixels()
    code, size = write_code(w, np.bincount(green, minlength=280))
    value, bits = code[green].astype(np.int64), size[green].astype(np.int64)
    before = w.n
    code, size = write_code(w, shared)
    w.bits(w.value >> before, w.n - before)
    parts = [(code[red], size[red]), (code[blue], size[blue])]
    code, size = write_code(w, np.bincount(alpha, minlength=256))
    write_lengths(w, np.zeros(40, np.int64))
    for more, n in (*parts, (code[alpha], size[alpha])):
        value |= more.astype(np.int64) << bits
        bits += n
    w.codes(value, bits)


def write_pixels(w: Writer, argb: np.ndarray, width: int, top: bool, cache_bits: int = 0, references: bool = False, tile_bits: int = 0) -> None:
    """Fitted codes; back-references; a colour cache; two groups of codes by tile."""
    total = len(argb)
    if not (top or cache_bits or references):
        _write_plain(w, argb)
        return
    copies = np.array(_repeats(argb) if references else [], np.int64).reshape(-1, 3)
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, copies[:, 0], 1)
    np.add.at(step, copies[:, 0] + copies[:, 1], -1)
    alone = np.flatnonzero(np.cumsum(step)[:total] == 0)
    start = np.concatenate([alone, copies[:, 0]])
    order = np.argsort(start, kind="stable")
    start, pixel = start[order], argb[start[order]]
    # 0: a literal, 1: a copy, 2: a cached colour
    kind = np.repeat([0, 1], [len(alone), len(copies)])[order]
    slot = np.zeros(total, np.int64)
    if cache_bits:
        slot = ((argb * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        hit = np.zeros(total, bool)
        hit[by[1:]] = (slot[by[1:]] == slot[by[:-1]]) & (argb[by[1:]] == argb[by[:-1]])
        kind[(kind == 0) & hit[start]] = 2
    w.bits(bool(cache_bits), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    group, groups = np.zeros(len(start), np.int64), 1
    if top:
        w.bits(bool(tile_bits), 1)
        if tile_bits:
            across, down = _up(width, 1 << tile_bits), _up(_up(total, width), 1 << tile_bits)
            w.bits(tile_bits - 2, 3)
            write_pixels(w, _tile_groups(across * down), across, False)
            groups = min(2, across * down)
            group = ((start // width >> tile_bits) * across + (start % width >> tile_bits)) % 2
    near, d = _near_codes(width), copies[:, 2]
    d = np.where((d < len(near)) & (near[np.minimum(d, len(near) - 1)] > 0), near[np.minimum(d, len(near) - 1)], d + len(NEAR))
    length, far = _prefixes(copies[:, 1]), _prefixes(d)
    copy, lit = kind == 1, kind == 0
    symbols = np.zeros((len(start), 5), np.int64)
    symbols[:, 0] = np.where(kind == 2, 280 + slot[start], pixel >> np.uint32(8) & np.uint32(255))
    symbols[copy, 0], symbols[copy, 4] = 256 + length[0], far[0]
    for k, shift in ((1, 16), (2, 0), (3, 24)):
        symbols[:, k] = pixel >> np.uint32(shift) & np.uint32(255)
    values, bits = np.zeros((len(start), 4), np.int32), np.zeros((len(start), 4), np.int32)
    for g in range(groups):
        own = group == g
        literals = (own & lit).nonzero()[0]
        rows = (own.nonzero()[0], literals, literals, literals, (own & copy).nonzero()[0])
        count = [np.bincount(symbols[rows[k], k], minlength=size) for k, size in enumerate((280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))]
        count[1] = count[2] = count[1] + count[2]  # red and blue are alike here: one code for both
        for k in range(5):
            s = symbols[rows[k], k]
            at = w.n
            code, wide = write_code(w, count[k]) if k != 2 else (code, wide)
            if k == 1:
                same = w.value >> at, w.n - at
            elif k == 2:
                w.bits(*same)
            column = 2 if k == 4 else k
            values[rows[k], column], bits[rows[k], column] = code[s], wide[s]
    for column, (_, more, extra) in ((1, length), (3, far)):
        values[copy, column], bits[copy, column] = more, extra
    w.codes(values.reshape(-1), bits.reshape(-1))


#: Larger images are written one by one.
LARGE = 1 << 16


def _written_side_by_side(images: list[tuple[Writer, np.ndarray, int, int, int]]) -> list[bytes]:
    """The streams of writers, each after write_pixels(w, argb, width, True, cache_bits, True, tile_bits): all but the codes is done for all images at once."""
    n, sizes = len(images), 280 + (1 << 11)
    argb, total = np.concatenate([x[1] for x in images]), np.array([len(x[1]) for x in images])
    cache_bits = np.array([x[3] for x in images])
    image = np.repeat(np.arange(n), total)
    copies = np.array(_repeats(argb, image), np.int64).reshape(-1, 3)
    step = np.zeros(len(argb) + 1, np.int8)
    step[copies[:, 0]] += 1
    step[copies[:, 0] + copies[:, 1]] -= 1
    # 0: a literal, 1: a copy, 2: a cached colour, 3: within a copy
    kind = np.cumsum(step[:-1], dtype=np.int8) * np.int8(3)
    kind[copies[:, 0]] = 1
    some = np.flatnonzero(np.repeat(cache_bits > 0, total))
    slot = np.zeros(len(argb), np.int64)
    slot[some] = (argb[some] * np.uint32(CACHE_MULTIPLIER)).astype(np.int64) >> (32 - cache_bits[image[some]])
    place = slot[some] + (image[some] << 11)
    by = _in_order(place)
    hit = some[by[1:][(place[by[1:]] == place[by[:-1]]) & (argb[some[by[1:]]] == argb[some[by[:-1]]])]]
    kind[hit[kind[hit] == 0]] = 2
    start = np.flatnonzero(kind < 3)
    kind, pixel, of = kind[start], argb[start].astype(np.int64), image[start]
    copy, lit = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
    widths, which = np.unique([x[2] for x in images], return_inverse=True)
    near = np.zeros((len(widths), 8 * int(widths[-1]) + 9), np.int64)
    for row, width in zip(near, widths.tolist(), strict=True):
        row[: 8 * width + 9] = _near_codes(width)
    d = copies[:, 2]
    short = near[which[of[copy]], np.minimum(d, near.shape[1] - 1)]
    length, far = _prefixes(copies[:, 1]), _prefixes(np.where((d < near.shape[1]) & (short > 0), short, d + len(NEAR)))
    green = np.where(kind == 2, 280 + slot[start], pixel >> 8 & 255)
    green[copy] = 256 + length[0]
    red, blue, alpha = (pixel[lit] >> shift & 255 for shift in (16, 0, 24))
    # Sets of codes: one for an image, two for one with tiles.
    across, tiles = (np.array([f(len(a), width, t) if t else 1 for _, a, width, _, t in images]) for f in (lambda _, width, t: _up(width, 1 << t), lambda n, width, t: _up(width, 1 << t) * _up(_up(n, width), 1 << t)))
    groups = np.minimum(2, tiles)
    first_set = np.cumsum(groups) - groups
    group = first_set[of]
    tiled = np.flatnonzero(groups[of] > 1)
    if len(tiled):
        own, width, tile_bits = of[tiled], np.array([x[2] for x in images])[of[tiled]], np.array([x[4] for x in images])[of[tiled]]
        at = start[tiled] - (np.cumsum(total) - total)[own]
        group[tiled] += ((at // width >> tile_bits) * across[own] + (at % width >> tile_bits)) % 2
    sets = int(groups.sum())
    count = lambda at, symbol, size: np.bincount(group[at] * size + symbol, minlength=sets * size).reshape(sets, size)
    counts = count(slice(None), green, sizes), count(lit, red, 256) + count(lit, blue, 256), count(lit, alpha, 256), count(copy, far[0], 40)
    lengths = [np.zeros(c.shape, np.int64) for c in counts]
    for i, (w, _, _, cached, tile_bits) in enumerate(images):
        w.bits(bool(cached), 1)
        if cached:
            w.bits(cached, 4)
        w.bits(bool(tile_bits), 1)
        if tile_bits:
            w.bits(tile_bits - 2, 3)
            _write_plain(w, _tile_groups(int(tiles[i])))
        for g in range(first_set[i], first_set[i] + groups[i]):
            for k, c in enumerate(counts):
                own = c[g, : 280 + (1 << cached if cached else 0)] if k == 0 else c[g]
                before = w.n
                lengths[k][g, : len(own)] = write_lengths(w, own)
                if k == 1:  # red and blue have one code
                    w.bits(w.value >> before, w.n - before)
    codes, bits = zip(*map(all_stream_codes, lengths), strict=True)
    # A token's parts as one number of 60 bits at most.
    value, size = codes[0][group, green], bits[0][group, green]

    def add(at: np.ndarray, more: np.ndarray, n_bits: np.ndarray) -> None:
        value[at] |= more << size[at]
        size[at] += n_bits

    for k, symbol in ((1, red), (1, blue), (2, alpha)):
        add(lit, codes[k][group[lit], symbol], bits[k][group[lit], symbol])
    add(copy, length[1], length[2])
    add(copy, codes[3][group[copy], far[0]], bits[3][group[copy], far[0]])
    add(copy, far[1], far[2])
    # Each stream begins at a word; its first bits, which its writer has, are laid over it afterwards.
    heads = [(w.bytes(), sum(map(len, w.parts))) for w, *_ in images]
    tokens = np.bincount(of, minlength=n)
    end = np.cumsum(size)
    edge = np.append(0, end)[np.cumsum(np.append(0, tokens))]
    head = np.array([x for _, x in heads])
    whole = head + np.diff(edge)
    words = whole + 127 >> 6
    base = np.cumsum(words) - words
    at = end - size - edge[of] + head[of] + (base[of] << 6)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    value = value.view(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.add.reduceat(value << shift, first)
    over = np.flatnonzero((at & 63) + size > 64)
    out[word[over] + 1] += value[over] >> (np.uint64(64) - shift[over])
    raw, streams = out.tobytes(), []
    for (own, _), b, n_bits in zip(heads, base.tolist(), whole.tolist(), strict=True):
        stream = bytearray(raw[8 * b : 8 * b + _up(n_bits, 8)])
        if own:
            own = own[:-1] + bytes([own[-1] | stream[len(own) - 1]]) if len(stream) >= len(own) else own
            stream[: len(own)] = own
        streams.append(bytes(stream))
    return streams


# -- transforms --------------------------------------------------------------------------------------------


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb).view(np.uint8).reshape(*argb.shape, 4)  # blue, green, red, alpha


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a & b) + ((a ^ b) >> 1)


_BLACK = np.array([0, 0, 0, 255], np.uint8)
#: Modes that need no pixel of the same row but the left one: rows are inverted at once.
ROWWISE = (1, 2, 3, 4, 8, 9)


def predicted(mode: int, left: np.ndarray, above: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The format's prediction for arrays of pixels inside the image; right and corner are the upper ones. The last axis has the channels."""
    wide = lambda x: x.astype(np.int16)
    match mode:
        case 1:
            return left
        case 2:
            return above
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _mean(_mean(left, right), above)
        case 6:
            return _mean(left, corner)
        case 7:
            return _mean(left, above)
        case 8:
            return _mean(corner, above)
        case 9:
            return _mean(above, right)
        case 10:
            return _mean(_mean(left, corner), _mean(above, right))
        case 11:
            to_left = np.abs(wide(above) - corner).sum(axis=-1, keepdims=True)
            return np.where(to_left < np.abs(wide(left) - corner).sum(axis=-1, keepdims=True), left, above)
        case 12:
            return np.clip(wide(left) + above - corner, 0, 255).astype(np.uint8)
        case 13:
            middle = wide(_mean(left, above))
            step = middle - corner
            return np.clip(middle + np.where(step < 0, -(-step // 2), step // 2), 0, 255).astype(np.uint8)
        case _:
            return np.broadcast_to(_BLACK, left.shape)


def _modes(image: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """The mode of each pixel's tile, in rows."""
    tiles = (image >> 8 & 15).reshape(-1, _up(width, 1 << bits))
    return tiles[np.arange(height)[:, None] >> bits, np.arange(width) >> bits]


def invert_predictor(argb: np.ndarray, width: int, image: np.ndarray, bits: int) -> np.ndarray:
    """The pixel right of a row's end is the row's first."""
    out = _channels(argb.reshape(-1, width)).copy()
    height = len(out)
    tiles = (image >> 8 & 15).reshape(-1, _up(width, 1 << bits))
    column = np.arange(width)
    out[0, 0] += _BLACK
    out[0] = out[0].cumsum(axis=0, dtype=np.uint8)
    for tile, of_tiles in enumerate(tiles):
        own = of_tiles[column >> bits]
        own[0] = 2
        kinds = set(own.tolist())
        where = {k: (own == k).nonzero()[0] for k in kinds - {1}}
        left = (own == 1)[:, None] if 1 in kinds else None
        start = np.maximum.accumulate(np.where(own == 1, 0, column))
        shifted = not kinds <= {1, 2, 14, 15, 0}
        for y in range(max(1, tile << bits), min(height, (tile + 1) << bits)):
            row, above = out[y], out[y - 1]
            if len(kinds) == 1:
                row += above
                continue
            row[0] += above[0]
            right = corner = above
            if shifted:
                right, corner = np.concatenate([above[1:], row[:1]]), np.concatenate([above[:1], above[:-1]])
            if not kinds <= {0, 14, 15, *ROWWISE}:
                for x in range(1, width):
                    row[x] += predicted(int(own[x]), row[x - 1], above[x], right[x], corner[x])
                continue
            for kind, x in where.items():
                x = x[1:] if kind == 2 else x
                row[x] += predicted(kind, above[x], above[x], right[x], corner[x])
            if left is not None:
                run = np.where(left, row, 0).cumsum(axis=0, dtype=np.uint8)
                row[:] = np.where(left, row[start] + (run - run[start]), row)
    return out.view(np.uint32).reshape(-1)


def apply_predictor(argb: np.ndarray, width: int, bits: int, modes: Sequence[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The differences and the image of modes: those given, tile by tile in turn, or of ROWWISE the one with the least differences."""
    own = _channels(argb.reshape(-1, width))
    height = len(own)
    left, above, corner, right = (np.zeros_like(own) for _ in range(4))
    left[:, 1:], above[1:], corner[1:, 1:], right[1:, :-1], right[1:, -1] = own[:, :-1], own[:-1], own[:-1, :-1], own[:-1, 1:], own[1:, 0]
    across, down = _up(width, 1 << bits), _up(height, 1 << bits)
    if modes is None:
        cost = []
        for kind in ROWWISE:
            d = own - predicted(kind, left, above, right, corner)
            d = np.minimum(d, -d).view(np.uint32)[:, :, 0]
            d = (d & np.uint32(0xFF00FF)) + (d >> np.uint32(8) & np.uint32(0xFF00FF))
            size = ((d & np.uint32(0xFFFF)) + (d >> np.uint32(16))).astype(np.int64)  # the channels' sum
            cost.append(np.add.reduceat(np.add.reduceat(size, np.arange(down) << bits, axis=0), np.arange(across) << bits, axis=1))
        chosen = np.array(ROWWISE)[np.argmin(cost, axis=0)].reshape(-1)
    else:
        chosen = np.resize(np.array(modes), across * down)
    image = (chosen.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    by_pixel = _modes(image, width, height, bits)
    guess = np.zeros_like(own)
    for kind in set(chosen.tolist()):
        where = by_pixel == kind
        guess[where] = predicted(kind, left[where], above[where], right[where], corner[where])
    guess[1:, 0], guess[0, 1:], guess[0, 0] = above[1:, 0], left[0, 1:], _BLACK
    return np.ascontiguousarray(own - guess).view(np.uint32).reshape(-1), image


def cross_colour(argb: np.ndarray, width: int, image: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """sign 1 inverts, -1 applies."""
    n = np.arange(len(argb))
    element = _channels(image).view(np.int8)[(n // width >> bits) * _up(width, 1 << bits) + (n % width >> bits)].astype(np.int32)
    out = _channels(argb.copy())
    delta = lambda t, c: (t * c.view(np.int8).astype(np.int32)) >> 5
    green = np.ascontiguousarray(out[:, 1])
    before = np.ascontiguousarray(out[:, 2])
    after = (before + sign * delta(element[:, 0], green)).astype(np.uint8)
    plain = after if sign > 0 else before  # red without the transform
    out[:, 0] = out[:, 0] + sign * (delta(element[:, 1], green) + delta(element[:, 2], plain))
    out[:, 2] = after
    return out.view(np.uint32).reshape(-1)


def fitted_colours(argb: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Elements of the cross-colour transform: for each tile the slopes of red and blue by green, and of what is left of blue by red."""
    c = _channels(argb).view(np.int8).astype(np.int64)
    n, across = np.arange(len(argb)), _up(width, 1 << bits)
    tile = (n // width >> bits) * across + (n % width >> bits)
    tiles = int(tile[-1]) // across * across + across
    total = lambda x: np.bincount(tile, x, tiles)
    slope = lambda y, x: np.clip(np.rint(32 * total(x * y) / np.maximum(total(x * x), 1)), -128, 127).astype(np.int64)
    blue, green, red = c[:, 0], c[:, 1], c[:, 2]
    by_green = slope(blue, green)
    parts = (slope(red, green), by_green, slope(blue - (by_green[tile] * green >> 5), red))
    return sum(((p & 255).astype(np.uint32) << np.uint32(s) for p, s in zip(parts, (0, 8, 16), strict=True)), np.uint32(0xFF000000)).astype(np.uint32)


def subtract_green(argb: np.ndarray, sign: int) -> np.ndarray:
    """sign 1 inverts, -1 applies."""
    out = _channels(argb.copy())
    green = out[:, 1] if sign > 0 else -out[:, 1]
    out[:, 0] += green
    out[:, 2] += green
    return out.view(np.uint32).reshape(-1)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def invert_palette(argb: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    shift = _bundle(len(table))
    packed = (argb >> 8 & 255).reshape(height, _up(width, 1 << shift))
    x, bits = np.arange(width), 8 >> shift
    index = packed[:, x >> shift] >> (bits * (x & (1 << shift) - 1)).astype(np.uint32) & (1 << bits) - 1
    padded = np.zeros(256, np.uint32)
    padded[: len(table)] = table
    return padded[index].reshape(-1)


# -- files -------------------------------------------------------------------------------------------------


def _opened(data: bytes) -> tuple[int, int, list[tuple], tuple]:
    """Of a lossless WebP file: width, height, transforms to undo, and its reader at the image itself, which is so wide."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack_from("<I", data, 16)
    r = Reader(data[20 : 20 + size])
    if r.bits(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height = 1 + r.bits(14), 1 + r.bits(14)
    r.bits(1)
    if r.bits(3):
        raise ValueError("an unknown version")
    undo, own = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = 2 + r.bits(3)
            image = read_pixels(r, _up(own, 1 << bits), _up(height, 1 << bits), False)
            undo.append((kind, own, image, bits))
        elif kind == PALETTE:
            table = read_pixels(r, 1 + r.bits(8), 1, False)
            table = np.cumsum(_channels(table), axis=0, dtype=np.uint8).view(np.uint32).reshape(-1)
            undo.append((kind, own, table, 0))
            own = _up(own, 1 << _bundle(len(table)))
        else:
            undo.append((kind, own, None, 0))
    return width, height, undo, (r, own)


def _undone(argb: np.ndarray, width: int, height: int, undo: list[tuple]) -> np.ndarray:
    for kind, across, image, bits in reversed(undo):
        if kind == PREDICTOR:
            argb = invert_predictor(argb, across, image, bits)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, across, image, bits, 1)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb, 1)
        else:
            argb = invert_palette(argb, across, height, image)
    return _channels(argb.reshape(height, width))[:, :, [2, 1, 0, 3]]


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file's pixels: an array (height, width, 4) of red, green, blue and alpha."""
    width, height, undo, (r, own) = _opened(data)
    return _undone(_read(r, *_image_codes(r, own, height, True)), width, height, undo)


def _with_codes(opened: list[tuple]) -> Iterator[tuple]:
    """Each file with its reader and what _image_codes() gives; codes are read side by side."""
    readers = [r for *_, (r, _) in opened]
    heads = [_image_head(r, own, height, True) for _, height, _, (r, own) in opened]
    raw = b"".join(r.data for r in readers) + bytes(256)
    words = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,)).astype(np.int64)
    words &= (1 << 62) - 1
    base = np.append(0, np.cumsum([len(r.data) for r in readers])).tolist()
    codes: list[list[Code]] = [[] for _ in opened]
    for k in range(5 * max((groups for groups, *_ in heads), default=0)):
        own = [i for i, (groups, *_) in enumerate(heads) if 5 * groups > k]
        read = _read_codes([readers[i] for i in own], [_sizes(heads[i][2])[k % 5] for i in own], [base[i] for i in own], words)
        for i, code in zip(own, read, strict=True):
            codes[i].append(code)
    for i, (one, (groups, group_of, cache_bits)) in enumerate(zip(opened, heads, strict=True)):
        width = one[3][1]
        yield one, (readers[i], [codes[i][5 * g : 5 * g + 5] for g in range(groups)], group_of, width, width * one[1], cache_bits)


def decode_all(files: Sequence[bytes]) -> list[np.ndarray]:
    """decode() of each. Images are read side by side, but for the longest ones (a step for a few images is no gain), and those that have bits for alpha."""
    opened = [(width, height, undo, image) for (width, height, undo, _), image in _with_codes([_opened(data) for data in files])]
    fit = [i for i, (*_, (_, codes, _, _, total, _)) in enumerate(opened) if total >= FEW and not any(own[3].wide or own[3].table[0] != codes[0][3].table[0] for own in codes)]
    fit = sorted(fit, key=lambda i: opened[i][3][4])[: -SIDES or None]
    pixels = dict(zip(fit, _side_by_side([opened[i][3] for i in fit]), strict=True)) if fit else {}
    return [_undone(pixels[i] if i in pixels else _read(*image), width, height, undo) for i, (width, height, undo, image) in enumerate(opened)]


def _file(stream: bytes) -> bytes:
    odd = b"\0" * (len(stream) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(stream) + len(odd), b"WEBP", b"VP8L", len(stream)) + stream + odd


def encode(rgba: np.ndarray, transforms: Sequence[int] = (), cache_bits: int = 0, references: bool = True, tile_bits: int = 0, bits: int = 5, modes: Sequence[int] | None = None) -> bytes:
    """Fitted codes and whatever is asked for; predictor modes (fitted, or those given in turn) and colour elements vary by tile."""
    w, argb, own = _prepared(rgba, transforms, bits, modes)
    write_pixels(w, argb, own, True, cache_bits, references, tile_bits)
    return _file(w.bytes())


def _prepared(rgba: np.ndarray, transforms: Sequence[int], bits: int = 5, modes: Sequence[int] | None = None) -> tuple[Writer, np.ndarray, int]:
    """What stands before the image itself, the image's ARGB words, and its width."""
    height, width, _ = rgba.shape
    argb = np.ascontiguousarray(rgba[:, :, [2, 1, 0, 3]]).view(np.uint32).reshape(-1)
    w, own = Writer(), width
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.bits(value, n)
    for kind in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        if kind == PREDICTOR:
            argb, image = apply_predictor(argb, own, bits, modes)
            w.bits(bits - 2, 3)
            write_pixels(w, image, _up(own, 1 << bits), False)
        elif kind == CROSS_COLOUR:
            image = fitted_colours(argb, own, bits)
            w.bits(bits - 2, 3)
            write_pixels(w, image, _up(own, 1 << bits), False)
            argb = cross_colour(argb, own, image, bits, -1)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb, -1)
        else:
            table, index = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours for a palette")
            steps = _channels(table).copy()
            steps[1:] -= steps[:-1].copy()
            w.bits(len(table) - 1, 8)
            write_pixels(w, steps.view(np.uint32).reshape(-1), len(table), False)
            shift = _bundle(len(table))
            packed = np.zeros((height, _up(own, 1 << shift) << shift), np.uint32)
            packed[:, :own] = index.reshape(height, own)
            packed = packed.reshape(height, -1, 1 << shift) << ((8 >> shift) * np.arange(1 << shift)).astype(np.uint32)
            argb = (np.bitwise_or.reduce(packed, axis=2).reshape(-1) << np.uint32(8) | np.uint32(0xFF000000)).astype(np.uint32)
            own = _up(own, 1 << shift)
    w.bits(0, 1)
    return w, argb, own


# -- payloads ----------------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """With blanks up to a positive multiple of STEP."""
    return text.ljust(max(1, _up(len(text), STEP)) * STEP, b" ")


#: Transforms, bits of the colour cache, and bits of the tiles of codes, by checksum; images of few colours have a palette instead.
FORMS = (
    ((SUBTRACT_GREEN,), 0, 0),
    ((SUBTRACT_GREEN,), 6, 0),
    ((SUBTRACT_GREEN,), 0, 0),
    ((PREDICTOR,), 0, 0),
    ((SUBTRACT_GREEN,), 0, 0),
    ((CROSS_COLOUR,), 0, 0),
    ((SUBTRACT_GREEN,), 0, 5),
    ((PREDICTOR, CROSS_COLOUR), 5, 0),
)
#: A palette is written if each of its colours stands for so many pixels.
PALETTE_PIXELS = 4


def _form(payload: bytes) -> tuple[np.ndarray, Sequence[int], int, int]:
    """A payload's pixels, and its file's transforms, bits of the colour cache and of the tiles of codes. The image may end with blanks that are not of the payload."""
    rows = len(payload) // (3 * WIDTH)
    across = _up(rows, MOST)
    height = _up(rows, across)
    samples = np.frombuffer(payload.ljust(across * height * 3 * WIDTH, b" "), np.uint8)
    pixels = np.full((height, across * WIDTH, 4), 255, np.uint8)
    pixels[:, :, :3] = samples.reshape(height, across * WIDTH, 3)
    transforms, cache_bits, tile_bits = FORMS[zlib.crc32(payload) % len(FORMS)]
    first = pixels.reshape(-1, 4)[:1024].view(np.uint32)
    if len(np.unique(first)) <= 256 and PALETTE_PIXELS * len(np.unique(pixels.view(np.uint32))) <= min(height * across * WIDTH, 256 * PALETTE_PIXELS):
        transforms = (PALETTE,)
    return pixels, transforms, cache_bits, tile_bits


def store(payload: bytes) -> bytes:
    """A payload as a file."""
    pixels, transforms, cache_bits, tile_bits = _form(payload)
    return encode(pixels, transforms, cache_bits, True, tile_bits)


def store_all(payloads: Sequence[bytes]) -> list[bytes]:
    """store() of each, the same bytes. Images are written side by side, but for those of over LARGE pixels."""
    out, side = [b""] * len(payloads), []
    for i, payload in enumerate(payloads):
        pixels, transforms, cache_bits, tile_bits = _form(payload)
        w, argb, own = _prepared(pixels, transforms)
        if len(argb) > LARGE:
            write_pixels(w, argb, own, True, cache_bits, True, tile_bits)
            out[i] = _file(w.bytes())
        else:
            side.append((i, w, argb, own, cache_bits, tile_bits))
    if side:
        for (i, *_), stream in zip(side, _written_side_by_side([x[1:] for x in side]), strict=True):
            out[i] = _file(stream)
    return out


def load(media: bytes, n: int) -> tuple[bytes, np.ndarray]:
    """The first n bytes of a file's samples, and its pixels."""
    pixels = decode(media)
    return pixels[:, :, :3].tobytes()[:n], pixels


def feature(pixels: np.ndarray) -> str:
    """Size, means of the channels, and a hash of 8 x 8 tiles: whether a tile is lighter than the whole."""
    height, width, _ = pixels.shape
    light = pixels[:, :, :3].sum(axis=2, dtype=np.int64)
    down, across = np.arange(8) * height // 8, np.arange(8) * width // 8
    sums = np.add.reduceat(np.add.reduceat(light, down, axis=0), across, axis=1)
    tall, wide = np.maximum(np.diff(np.append(down, height)), 1), np.diff(np.append(across, width))
    tiles = sums * light.size > light.sum() * tall[:, None] * wide
    code = np.packbits(tiles).tobytes().hex()
    red, green, blue = (pixels[:, :, :3].reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // light.size).tolist()
    return f"{width}x{height} {red},{green},{blue} {code}"


#: Texts, or files, that are taken side by side: so many, or of so many bytes.
FILES, FILES_BYTES = 640, 4 << 20


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    _, offsets = text_bytes(batch.column(column))
    for begin, end in chunks(offsets, FILES_BYTES):
        n = _up(end - begin, FILES)  # parts of about the same number
        for k in range(n):
            first, stop = begin + k * (end - begin) // n, begin + (k + 1) * (end - begin) // n
            yield batch.slice(first, stop - first)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch, 1):
            own = [(x.as_py() or "").encode() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, own)), pa.int64()), pa.array(store_all([padded(x) for x in own]), pa.binary())], names=["id", "n_bytes", "media"])


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text as a file."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_stored, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def write_media(df: DataFrame) -> DataFrame:
    """Writes a media table to the shared folder, its pages compressed with zstandard, and reads it back."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/cladewise-media-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for part in _parts(batch, 2):
            files, out = [x.as_py() for x in part.column(2)], []
            for n, data, pixels in zip(part.column(1).to_pylist(), files, decode_all(files), strict=True):
                payload = pixels[:, :, :3].tobytes()[: max(1, _up(n, STEP)) * STEP]
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(pixels)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n_bytes", *names])


def features(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of a media table: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    kind = table.schema[id_col].dataType.simpleString()
    out = table.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(_loaded, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
