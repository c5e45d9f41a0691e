import hashlib
import itertools
import zlib

import numpy as np
import pytest

from cladewise.llm import webp

KINDS = (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN)


def picture(seed, height, width, colours=None):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
    if colours:
        x = x.reshape(-1, 4)[:colours][rng.integers(0, colours, (height, width))]
    x[height // 2 :, : width // 2] = x[0, 0]
    return np.ascontiguousarray(x)


@pytest.mark.parametrize("kinds", [k for n in range(4) for k in itertools.permutations(KINDS, n)])
def test_transforms_are_inverted(kinds):
    for seed, (h, w) in enumerate([(1, 1), (1, 9), (13, 1), (20, 37)]):
        x = picture(seed, h, w)
        assert np.array_equal(webp.decode(webp.encode(x, kinds, bits=3)), x)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
@pytest.mark.parametrize("more", [(), (webp.PREDICTOR,)])
def test_palettes(colours, more):
    x = picture(colours, 24, 19, colours)
    assert np.array_equal(webp.decode(webp.encode(x, (webp.PALETTE, *more), cache_bits=2)), x)


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("tile_bits", [0, 2, 4])
def test_references_cache_and_tiles(cache_bits, tile_bits):
    for seed in range(3):
        x = picture(seed, 33, 29, 40)
        data = webp.encode(x, (), cache_bits, True, tile_bits)
        assert np.array_equal(webp.decode(data), x)
        assert len(data) < len(webp.encode(x, (), 0, False)) or cache_bits == 11


def by_hand(*fields):
    """A file from (value, bits) fields, written as the format's specification has them; bits of prefix codes as strings."""
    text = ""
    for f in fields:
        text += f if isinstance(f, str) else format(f[0], f"0{f[1]}b")[::-1] if f[1] else ""
    text += "0" * (-len(text) % 8)
    stream = bytes(int(text[k : k + 8][::-1], 2) for k in range(0, len(text), 8))
    odd = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(odd)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + odd


def start(width, height):
    return (0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)


def simple(*symbols):
    """A simple code of one or two symbols of 8 bits."""
    return (1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)


@pytest.mark.parametrize("few", [0, 1000])
def test_files_written_by_hand(monkeypatch, few):
    """Against bytes that no code of ours has written, by tables and symbol by symbol."""
    monkeypatch.setattr(webp, "FEW", few)
    none = ((0, 1), (0, 1), (0, 1))  # no transform, no cache, no groups
    # Two literals: green 5 or 9, red 7, blue 1, alpha 255.
    x = webp.decode(by_hand(*start(2, 1), *none, *simple(5, 9), *simple(7), *simple(1), *simple(255), *simple(0), "0", "1"))
    assert x.tolist() == [[[7, 5, 1, 255], [7, 9, 1, 255]]]
    # A normal code: lengths 1 for green 0, 2 for green 1 and for 257 (a copy of 2), so 0, 10 and 110...
    lengths = (0, 1), (15 - 4, 4), *((n, 3) for n in (2, 3, 3, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)), (0, 1)
    # The code length code by length and symbol: 1, 2 and 17 have 2 bits, 0 and 18 have 3.
    one, two, eighteen = "00", "01", "111"
    body = (one, two, eighteen, (127, 7), eighteen, (255 - 138 - 11, 7), two, eighteen, (22 - 11, 7))
    x = webp.decode(by_hand(*start(3, 1), *none, *lengths, *body, *simple(3), *simple(4), *simple(255), *simple(1), "10", "11"))
    # Distance prefix 1 is distance code 2: the pixel to the left.
    assert x[0, :, 1].tolist() == [1, 1, 1] and x[0, :, 0].tolist() == [3, 3, 3]
    # Subtract green.
    x = webp.decode(by_hand(*start(1, 1), (1, 1), (2, 2), *none, *simple(5), *simple(7), *simple(254), *simple(255), *simple(0)))
    assert x.tolist() == [[[12, 5, 3, 255]]]
    # A palette of two colours, the second as differences; eight pixels of a row in one green.
    table = ((1, 1), (3, 2), (1, 8), (0, 1), *simple(10, 20), *simple(1), *simple(2), *simple(255, 0), *simple(0), "0", "1", "1", "0")
    x = webp.decode(by_hand(*start(3, 1), *table, *none, *simple(0b101), *simple(0), *simple(0), *simple(255), *simple(0)))
    assert x[0].tolist() == [[2, 30, 4, 255], [1, 10, 2, 255], [2, 30, 4, 255]]
    # A predictor of mode 12 over a 2 x 2 image: black, left, above, then clamped left + above - corner.
    tile = ((1, 1), (0, 2), (0, 3), (0, 1), *simple(12), *simple(0), *simple(0), *simple(255), *simple(0))
    x = webp.decode(by_hand(*start(2, 2), *tile, *none, *simple(100, 60), *simple(1), *simple(0), *simple(0), *simple(0), "1", "1", "0", "0"))
    assert x[:, :, 1].tolist() == [[100, 200], [160, (255 + 60) % 256]] and x[:, :, 0].tolist() == [[1, 2], [2, 4]] and (x[:, :, 3] == 255).all()
    # A colour cache of one bit: a literal, then the cached colour of its place.
    cache = ((0, 1), (1, 1), (1, 4), (0, 1))
    # A normal code of two symbols of length 1, whose code length code has 18 and 1.
    lengths = (0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1)
    # 18 is "1" and 1 is "0": zeros come in runs of 11 or more, so the literal is green 11, and the place is 1.
    red = next(x for x in range(256) if (0x1E35A7BD * (255 << 24 | x << 16 | 11 << 8 | 1) & 0xFFFFFFFF) >> 31)
    body = ("1", (0, 7), "0", "1", (127, 7), "1", (281 - 12 - 138 - 11, 7), "0")
    x = webp.decode(by_hand(*start(3, 1), *cache, *lengths, *body, *simple(red), *simple(1), *simple(255), *simple(0), "0", "1", "1"))
    assert x.tolist() == [[[red, 11, 1, 255]] * 3]


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor_mode(mode):
    for h, w in [(1, 1), (2, 1), (1, 2), (17, 21), (9, 70)]:
        x = picture(mode, h, w)
        assert np.array_equal(webp.decode(webp.encode(x, (webp.PREDICTOR,), modes=[mode])), x)
        assert np.array_equal(webp.decode(webp.encode(x, (webp.PREDICTOR,), bits=2, modes=[mode, 1, (mode * 5 + 3) % 14])), x)


@pytest.mark.parametrize("span", [64, 200, 1 << 18])
def test_tables_give_what_single_symbols_give(monkeypatch, span):
    monkeypatch.setattr(webp, "SPAN", span)
    for seed in range(6):
        x = picture(seed, 31, 40, 30 if seed % 2 else None)
        data = webp.encode(x, (webp.SUBTRACT_GREEN,), 3 * (seed % 3), True, 2 * (seed // 3))
        fast = webp.decode(data)
        with monkeypatch.context() as m:
            m.setattr(webp, "FEW", 1 << 30)
            assert np.array_equal(fast, webp.decode(data)) and np.array_equal(fast, x)


def test_long_runs_and_long_payloads():
    rng = np.random.default_rng(4)
    for payload in (b" " * 192 * 700, bytes(rng.integers(32, 122, 192 * 900, dtype=np.uint8)), b"ab cd e" * 192 * 60):
        data = webp.store(payload)
        assert webp.load(data, len(payload))[0] == payload


def test_format_values():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)
    data = webp.store(webp.padded(b"abc"))
    assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8 and data[20] == 0x2F
    assert int.from_bytes(data[21:23], "little") & 0x3FFF == 63
    for bad in (b"", data[:40], b"RIFX" + data[4:]):
        with pytest.raises(Exception):
            webp.decode(bad)


def test_payloads_longer_than_the_height(monkeypatch):
    monkeypatch.setattr(webp, "MOST", 4)
    for n in (0, 1, 192, 193, 192 * 4, 192 * 9 + 5):
        payload = webp.padded(bytes(range(256))[: n % 256] * (n // max(1, n % 256) + 1))
        assert webp.load(webp.store(payload), len(payload))[0] == payload


def test_stored_files_have_all_parts_of_the_format(monkeypatch):
    met = set()

    def noted(name):
        f = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a: (met.add(name), f(*a))[1])

    for name in ("invert_predictor", "cross_colour", "subtract_green", "invert_palette", "_walk"):
        noted(name)
    text = b"".join(b"%d words and then some more of the same, " % (k * k) for k in range(60))
    sizes = []
    for k in range(60):
        payload = webp.padded(text[k:] if k % 2 else text[: 3 * k])
        data = webp.store(payload)
        met.clear()
        got, pixels = webp.load(data, len(payload))
        assert got == payload and (pixels[:, :, 3] == 255).all()
        sizes.append((frozenset(met), len(data), len(payload)))
    assert set().union(*(m for m, _, _ in sizes)) == {"invert_predictor", "cross_colour", "subtract_green", "invert_palette", "_walk"}
    assert sum(n for _, n, _ in sizes) < sum(n for _, _, n in sizes)


def test_frames(spark):
    texts = [None, "", "abc", "abc", "é" * 500, "x" * 192, "y" * 50_000]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in webp.features(webp.write_media(webp.media(df))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(webp.store(payload)) and r.media_sha256 == hashlib.sha256(webp.store(payload)).hexdigest()
    assert got[2].feature == got[3].feature and got[0].feature == got[1].feature
    assert webp.features(webp.media(df.limit(0))).count() == 0


def test_many_files_at_once_are_what_each_is_alone(monkeypatch):
    """Of all forms, with images of a few and of very many pixels, and with ends cut off."""
    text = b"".join(b"%d words and then some more of the same, " % (k * k) for k in range(200))
    payloads = [webp.padded(text[7 * k : 7 * k + (k * 131) % 6000]) for k in range(150)] + [webp.padded(text * 40), webp.padded(b""), webp.padded("é".encode() * 900)]
    alone = [webp.store(x) for x in payloads]
    assert {webp.zlib.crc32(x) % len(webp.FORMS) for x in payloads} == set(range(len(webp.FORMS)))
    for large, sides in ((1 << 16, 32), (64, 1), (1 << 16, 0)):
        monkeypatch.setattr(webp, "LARGE", large)
        monkeypatch.setattr(webp, "SIDES", sides)
        assert webp.store_all(payloads) == alone
        got = webp.decode_all(alone)
        for x, data, pixels in zip(payloads, alone, got, strict=True):
            assert pixels[:, :, :3].tobytes()[: len(x)] == x and np.array_equal(pixels, webp.decode(data))
    odd = [webp.encode(picture(k, 20 + k, 30, 50 if k % 2 else None), (), 3 * (k % 3), True, 3 * (k % 2)) for k in range(12)]
    for data, pixels in zip(odd, webp.decode_all(odd), strict=True):
        assert np.array_equal(pixels, webp.decode(data))
    with pytest.raises(ValueError):
        webp.decode_all([*alone[20:60], alone[60][: len(alone[60]) // 2]])
    assert webp.store_all([]) == [] and webp.decode_all([]) == []


def test_reading_and_writing_calls_are_not_made_for_each_file(monkeypatch):
    """Tokens of a batch are read and written together, so that small files do not pay for each call alone."""
    calls = []
    for name in ("_by_tables", "write_pixels"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), name=name: (calls.append((name, *a[3:4])), f(*a))[1])
    rng = np.random.default_rng(7)
    payloads = [webp.padded(bytes(rng.integers(32, 122, 900 + k, dtype=np.uint8))) for k in range(200)]
    files = webp.store_all(payloads)
    assert [x[:, :, :3].tobytes()[: len(p)] for p, x in zip(payloads, webp.decode_all(files), strict=True)] == payloads
    assert sum(name == "_by_tables" for name, _ in calls) <= webp.SIDES and ("write_pixels", True) not in calls


def test_codes_of_many_files_are_read_side_by_side(monkeypatch):
    """Code lengths of many files in steps, and small images from their bits: the same pixels as file by file, and the same faults."""
    rng = np.random.default_rng(11)
    texts = [webp.padded(bytes(rng.choice(np.frombuffer(b"abcdefgh \nEtaoinshrdlu", np.uint8), int(n)))) for n in rng.integers(300, 9000, 60)]
    files = webp.store_all(texts)
    assert files == [webp.store(x) for x in texts]
    steps = []
    inner = webp._read_codes
    monkeypatch.setattr(webp, "_read_codes", lambda readers, *rest: steps.append(len(readers)) or inner(readers, *rest))
    singly = []
    one = webp.read_code
    monkeypatch.setattr(webp, "read_code", lambda r, size: singly.append(size) or one(r, size))
    got = webp.decode_all(files)
    assert len(singly) < 5 * len(files) and max(steps) == len(files)
    for text, own, pixels in zip(texts, files, got, strict=True):
        assert pixels[:, :, :3].tobytes()[: len(text)] == text and np.array_equal(pixels, webp.decode(own))
    with pytest.raises(ValueError):
        webp.decode_all([x[:20] + x[20 : 20 + (len(x) - 20) // 3] for x in files])


def test_order_of_places_is_stable():
    rng = np.random.default_rng(2)
    for high in (3, 1 << 39):
        key = rng.integers(0, high, 5000)
        assert np.array_equal(webp._in_order(key), np.argsort(key, kind="stable"))
