"""The VP8L decoder on streams with every feature, written by a small writer here."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colstrata.llm import media, webp


def prefix(value):
    """(symbol, extra bits, their value) of a length or distance, counted from 1."""
    for symbol in range(40):
        if symbol < 4:
            if value == symbol + 1:
                return symbol, 0, 0
            continue
        extra = (symbol - 2) >> 1
        low = ((2 + (symbol & 1)) << extra) + 1
        if low <= value < low + (1 << extra):
            return symbol, extra, value - low
    raise AssertionError


def put_image(w, tokens, cache_bits=0, main=False):
    """tokens: ("lit", argb), ("ref", length, distance code) or ("cache", index)."""
    w.put(1, 1) if cache_bits else w.put(0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    rows = []
    for t in tokens:
        if t[0] == "lit":
            rows.append([(0, t[1] >> 8 & 255, 0, 0), (1, t[1] >> 16 & 255, 0, 0), (2, t[1] & 255, 0, 0), (3, t[1] >> 24, 0, 0)])
        elif t[0] == "ref":
            a, b = prefix(t[1]), prefix(t[2])
            rows.append([(0, 256 + a[0], a[1], a[2]), (4, b[0], b[1], b[2])])
        else:
            rows.append([(0, 280 + t[1], 0, 0)])
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    lengths = []
    for k, size in enumerate(sizes):
        used = np.bincount([s for r in rows for c, s, _, _ in r if c == k], minlength=size)
        if not used.any():
            used[0] = 1
        if np.count_nonzero(used) == 1 and used.argmax() > 255:
            used[0] = 1
        lengths.append(webp.code_lengths(used))
        webp.put_code(w, lengths[-1])
    codes = [webp._codes(n) for n in lengths]
    for r in rows:
        for c, s, extra, value in r:
            if np.count_nonzero(lengths[c]) > 1:
                w.put(int(codes[c][s]), int(lengths[c][s]))
            w.put(value, extra)


def start(width, height):
    w = webp.BitWriter()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def finish(w):
    return webp._file(np.packbits(w.bits(), bitorder="little").tobytes())


def picture(height, width, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)


def channels(p):
    return [(int(p) >> s) & 255 for s in (24, 16, 8, 0)]


def join(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def test_literals():
    p = picture(5, 7)
    w = start(7, 5)
    w.put(0, 1)
    put_image(w, [("lit", int(x)) for x in p.ravel()], main=True)
    got, n = webp.decode(finish(w) + b"rest")
    assert (got == p).all() and n == len(finish(w))


def test_back_references_and_cache():
    base = [int(x) for x in picture(1, 6, 1)[0]]
    width, out, tokens = 6, [], []
    for x in base:
        out.append(x), tokens.append(("lit", x))
    tokens.append(("ref", 6, 1))  # distance code 1 is the row above
    out += base
    tokens.append(("ref", 9, 120 + 5))  # plain distance 5, overlapping
    for _ in range(9):
        out.append(out[-5])
    bits = 4
    slot = lambda x: (0x1E35A7BD * x & 0xFFFFFFFF) >> (32 - bits)
    cache = {}
    for x in out:
        cache[slot(x)] = x
    for x in (out[-1], out[-2], out[-3]):
        if cache[slot(x)] == x:
            tokens.append(("cache", slot(x))), out.append(x)
    while len(out) % width:
        tokens.append(("lit", 77)), out.append(77)
        cache[slot(77)] = 77
    w = start(width, len(out) // width)
    w.put(0, 1)
    put_image(w, tokens, bits, main=True)
    assert webp.decode(finish(w))[0].ravel().tolist() == out


def predicted(mode, p, y, x):
    at = lambda j, i: channels(p[j, i]) if i < p.shape[1] else channels(p[j + 1, 0])
    if y == x == 0:
        return [255, 0, 0, 0]
    if y == 0:
        return at(0, x - 1)
    if x == 0:
        return at(y - 1, 0)
    left, top, tl, tr = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1)
    avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
    clip = lambda v: min(255, max(0, v))
    if mode == 11:
        estimate = [a + b - c for a, b, c in zip(left, top, tl)]
        return left if sum(abs(e - a) for e, a in zip(estimate, left)) < sum(abs(e - b) for e, b in zip(estimate, top)) else top
    half = avg(left, top)
    return {
        0: [255, 0, 0, 0], 1: left, 2: top, 3: tr, 4: tl, 5: avg(avg(left, tr), top), 6: avg(left, tl), 7: half, 8: avg(tl, top), 9: avg(top, tr), 10: avg(avg(left, tl), avg(top, tr)),
        12: [clip(a + b - c) for a, b, c in zip(left, top, tl)], 13: [clip(h + (abs(h - c) // 2) * (1 if h > c else -1)) for h, c in zip(half, tl)],
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    p = picture(6, 9, mode)
    residual = [join([(a - b) & 255 for a, b in zip(channels(p[y, x]), predicted(mode, p, y, x))]) for y in range(6) for x in range(9)]
    w = start(9, 6)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)  # tiles of 4
    put_image(w, [("lit", mode << 8)] * (3 * 2))
    w.put(0, 1)
    put_image(w, [("lit", r) for r in residual], main=True)
    assert (webp.decode(finish(w))[0] == p).all()


def test_cross_colour_then_subtract_green():
    p = picture(5, 6, 3)
    signed = lambda v: v - 256 if v > 127 else v
    move = lambda t, v: (signed(t) * signed(v)) >> 5
    red_of_green, blue_of_green, blue_of_red = 20, 250, 9
    coded = []
    for x in p.ravel():
        a, r, g, b = channels(x)
        r, b = (r - g) & 255, (b - g) & 255
        coded.append(join([a, (r - move(red_of_green, g)) & 255, g, (b - move(blue_of_green, g) - move(blue_of_red, r)) & 255]))
    w = start(6, 5)
    w.put(1, 1), w.put(2, 2)
    w.put(1, 1), w.put(1, 2), w.put(1, 3)
    put_image(w, [("lit", blue_of_red << 16 | blue_of_green << 8 | red_of_green)])
    w.put(0, 1)
    put_image(w, [("lit", c) for c in coded], main=True)
    assert (webp.decode(finish(w))[0] == p).all()


def test_meta_prefix_codes():
    p = picture(8, 8, 4)
    w = start(8, 8)
    w.put(0, 1), w.put(0, 1)
    w.put(1, 1), w.put(0, 3)  # tiles of 4
    put_image(w, [("lit", k << 8) for k in (0, 1, 1, 0)])
    flat = np.array([8] * 256 + [0] * 24)
    codes = webp._codes(flat)
    for _ in range(2):
        for k in range(4):
            webp.put_code(w, flat if k == 0 else flat[:256])
        webp._put_single(w, 0)
    for x in p.ravel():
        a, r, g, b = channels(x)
        for v in (g, r, b, a):
            w.put(int(codes[v]), 8)
    assert (webp.decode(finish(w))[0] == p).all()


@pytest.mark.parametrize("damage", [lambda b: b[:30], lambda b: b"JUNK" + b[4:], lambda b: b[:20] + b"\x00" + b[21:]])
def test_damage_is_an_error(damage):
    data = media.encode(media.payload("some text that is long enough to be coded, twice over")[0])
    with pytest.raises(webp.FormatError):
        webp.decode(damage(data))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_round_trip(text):
    p, n = media.payload(text)
    assert len(p) % 64 == 0 and len(p) >= 64 and p[:n] == text.encode()
    assert media.decode(media.encode(p)).tobytes() == p


def test_round_trip_of_frames_and_few_values():
    for text in ("abcdefgh" * 9000, "ab" * 40_000, "a" * 70_000, "".join(chr(32 + i % 90) for i in range(70_001))):
        p, _ = media.payload(text)
        assert media.decode(media.encode(p)).tobytes() == p


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=30), st.integers(1, 40)), min_size=1, max_size=12), st.integers(0, 3))
@settings(max_examples=80, deadline=None)
def test_round_trip_of_references(parts, tail):
    data = np.frombuffer(b"".join(p * k for p, k in parts), np.uint8)
    samples = np.resize(np.concatenate([data, np.arange(256, dtype=np.uint8)]), (len(data) // 64 + 4, 64))
    for refer in (False, True):
        flat = samples.ravel()
        codes, coded = webp._body(flat, 255, refer)
        bits = np.concatenate([codes.bits(), coded, np.zeros(64 + tail, np.uint8)])
        r = webp.BitReader(np.packbits(bits, bitorder="little").tobytes())
        groups = [webp._read_code(r, k) for k in (280, 256, 256, 256, 40)]
        read = webp._green_references(r, groups[0], groups[4], len(flat), 64) if refer else webp._green_only(r, groups[0], len(flat))
        assert (read == flat).all() and r.at == codes.n + len(coded)
    assert (media.decode(media.encode(samples.tobytes())) == samples).all()


def test_the_encoder_uses_what_pays():
    rng = np.random.default_rng(3)
    line = bytes(rng.integers(32, 127, 150).astype(np.uint8))
    repeated, once = media.payload((line * 200).decode())[0], media.payload(bytes(rng.integers(32, 127, 30_000).astype(np.uint8)).decode())[0]
    assert 30 * len(media.encode(repeated)) < len(repeated) and 2 * len(media.encode(once)) > len(once)
    ramp = (np.arange(64)[None, :] * 3 + np.arange(300)[:, None] * 5 + rng.integers(0, 3, (300, 64))).astype(np.uint8)
    stored = webp.encode(ramp)
    pixels, n = webp.decode(stored)
    assert (((pixels >> 8) & 255) == ramp).all() and n == len(stored) < ramp.size / 2
    assert (pixels >> 24 == 255).all() and (pixels & 0xFF00FF == 0).all()


def test_frames_of_a_long_text():
    text = "".join(chr(97 + i * i % 26) * (i % 5) for i in range(2_000_000))  # megabytes, many frames
    data, n = media.payload(text)
    assert media.decode(media.encode(data)).tobytes()[:n] == text.encode()
