"""Lossless WebP (VP8L) in numpy: an encoder for 8-bit samples and a decoder for the whole format.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and inverts the
predictor, cross-colour, subtract-green and palette transforms.  Streams whose only coded channel is green (such as the
encoder writes) are decoded with whole-array operations: every bit position gets the length of the code, or of the code,
reference and extra bits, that would start there, and jumps along these lengths give the positions that really start
one.  Predictors are inverted along slanted fronts, all pixels of a front at once.

The encoder stores one sample per pixel in the green channel.  Up to 16 distinct values are stored through a palette,
with 2, 4 or 8 pixels bundled in one; else samples are predicted from the left or from above where that
lowers their entropy.  Back-references are written where samples repeat enough to pay.  One channel has nothing that a
cross-colour transform or a colour cache could save, so neither is written.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

# fixed values of the format
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE, MAX_SIDE, LITERALS, LENGTHS, DISTANCES, CACHE_FACTOR = 0x2F, 1 << 14, 256, 24, 40, 0x1E35A7BD
#: Neighbours (x, y) of the 120 short distance codes, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class FormatError(ValueError):
    """The bytes are not a lossless WebP image that this decoder can read."""


# ---- writing


class BitWriter:
    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of a prefix code for symbols with these counts; a single symbol has length 1."""
    counts = counts.astype(np.int64)
    while True:
        used = np.flatnonzero(counts)
        lengths = np.zeros(len(counts), np.int64)
        if len(used) < 2:
            lengths[used] = 1
            return lengths
        heap = [(c, i) for i, c in enumerate(counts[used].tolist())]
        heapq.heapify(heap)
        up, free = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = free
            heapq.heappush(heap, (a[0] + b[0], free))
            free += 1
        depth = [0] * free
        for i in range(free - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        lengths[used] = depth[: len(used)]
        if lengths.max() <= limit:
            return lengths
        counts[used] = counts[used] // 2 + 1  # flatter, so shallower


def _reversed(bits: int) -> np.ndarray:
    """The numbers below 2**bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_TURNED = {bits: _reversed(bits) for bits in range(1, 16)}


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(used symbols by length, their codes' places among 15-bit words) of a canonical code."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (15 - lengths[used])
    return used, np.cumsum(room) - room


def _codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bit-reversed (the first bit of a code is the lowest)."""
    out = np.zeros(len(lengths), np.int64)
    used, place = _canonical(lengths)
    out[used] = _TURNED[15][place]
    return out


def _put_single(w: BitWriter, symbol: int) -> None:
    w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(symbol, 8)  # simple, one symbol, of 8 bits


def put_code(w: BitWriter, lengths: np.ndarray) -> None:
    """Write a prefix code's lengths, each in 4 plain bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] < 256:
        return _put_single(w, int(used[0]))
    last = int(used[-1]) + 1
    w.put(0, 1), w.put(15, 4)  # normal, all 19 length codes
    for sym in LENGTH_ORDER:
        w.put(4 if sym < 16 else 0, 3)
    w.put(1, 1), w.put(7, 3), w.put(max(last, 2) - 2, 16)
    n = max(last, 2)
    nibbles = np.append(_TURNED[4][lengths[:n]], 0)[: n + (n & 1)].astype(np.uint8)
    w.put(int.from_bytes((nibbles[::2] | nibbles[1::2] << 4).tobytes(), "little"), 4 * n)


def _laid(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of the values, each in its number of bits, lowest first."""
    end = np.cumsum(sizes)
    out, at = np.zeros(int(end[-1]) if len(end) else 0, np.uint8), end - sizes
    for b in range(int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > b)
        out[at[some] + b] = (values[some] >> b) & 1
    return out


def _pack(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bits of the coded symbols; none if there is a single symbol."""
    if np.count_nonzero(lengths) < 2:
        return np.zeros(0, np.uint8)
    return _laid(_codes(lengths).astype(np.uint16)[symbols], lengths[symbols])


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distances from 1."""
    v = values - 1
    high = np.zeros(len(v), np.int64)
    for b in range(1, 21):
        high += v >> b > 0
    extra = np.maximum(high - 1, 0)
    symbol = np.where(v < 4, v, 2 * high + ((v >> extra) & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << extra) - 1)), np.where(v < 4, 0, extra)


def references(flat: np.ndarray, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of a parse of the samples: literals have length 1 and distance 0; references go to the last
    place with the same ``least`` samples and as far as that distance holds."""
    n = len(flat)
    wide = np.zeros(n + least, np.uint64)
    wide[:n] = flat
    key = np.zeros(n, np.uint64)
    for k in range(least):
        key = (key << np.uint64(8)) | wide[k : k + n]
    order = np.argsort(key[: max(0, n - least + 1)], kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
    distance = np.zeros(n + 1, np.int64)
    distance[order[same]] = order[same] - order[same - 1]
    turn = np.append(np.flatnonzero(distance[1:] != distance[:-1]), n)
    run = turn[np.searchsorted(turn, np.arange(n))] - np.arange(n) + 1  # places from here on with this distance
    length = np.where(distance[:n] > 0, np.minimum(run + least - 1, 4096), 1)
    hop, at, starts = (np.arange(n) + length).tolist(), 0, []
    while at < n:
        starts.append(at)
        at = hop[at]
    start = np.array(starts, np.int64)
    return start, length[start], distance[start]


def _body(flat: np.ndarray, constant: int, refer: bool) -> tuple[BitWriter, np.ndarray]:
    """(prefix codes, coded samples) of a stream with or without references."""
    w = BitWriter()
    if not refer:
        lengths = code_lengths(np.bincount(flat, minlength=LITERALS + LENGTHS))
        put_code(w, lengths)
        _put_single(w, 0), _put_single(w, 0), _put_single(w, constant), _put_single(w, 0)
        return w, _pack(flat, lengths)
    start, length, distance = references(flat)
    copy = distance > 0
    l_sym, l_extra, l_bits = _prefixed(length)
    d_sym, d_extra, d_bits = _prefixed(np.where(copy, distance + 120, 1))
    symbol = np.where(copy, LITERALS + l_sym, flat[start])
    lengths = code_lengths(np.bincount(symbol, minlength=LITERALS + LENGTHS))
    far = code_lengths(np.bincount(d_sym[copy], minlength=DISTANCES)) if copy.any() else np.eye(1, DISTANCES, dtype=np.int64)[0]
    put_code(w, lengths)
    _put_single(w, 0), _put_single(w, 0), _put_single(w, constant)
    put_code(w, far)
    none = np.zeros(len(start), np.int64)
    one, single = np.count_nonzero(lengths) < 2, np.count_nonzero(far) < 2
    values = np.stack([_codes(lengths)[symbol], l_extra, _codes(far)[d_sym], d_extra], axis=1)
    sizes = np.stack([none if one else lengths[symbol], np.where(copy, l_bits, 0), none if single else np.where(copy, far[d_sym], 0), np.where(copy, d_bits, 0)], axis=1)
    return w, _laid(values.ravel(), sizes.ravel())


def _repetitive(flat: np.ndarray) -> bool:
    """Whether references are likely to pay: a cheap compressor gains a fifth by them."""
    raw = flat.tobytes()
    size = []
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY):
        z = zlib.compressobj(1, zlib.DEFLATED, -15, 8, strategy)
        size.append(len(z.compress(raw) + z.flush()))
    return size[0] < 0.8 * size[1]


def _entropy(samples: np.ndarray) -> float:
    """Bits of the samples under an ideal code of their own."""
    c = np.bincount(samples.ravel(), minlength=1)
    c = c[c > 0]
    return float(-(c * np.log2(c / samples.size)).sum())


def _residual(samples: np.ndarray, mode: int) -> np.ndarray:
    """Samples less their prediction from the left (1) or from above (2); the first row has the left, the first column the
    above."""
    out = samples.copy()
    if mode == 1:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
    else:
        out[1:] -= samples[:-1]
        out[0, 1:] -= samples[0, :-1]
    return out


def _file(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def encode(samples: np.ndarray) -> bytes:
    """A WebP file of ``samples`` (height, width; uint8), stored in the green channel of opaque pixels."""
    height, width = samples.shape
    w = BitWriter()
    w.put(SIGNATURE, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 1), w.put(0, 3)
    values = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(values) <= 16:
        w.put(1, 1), w.put(3, 2), w.put(len(values) - 1, 8)  # palette: green values as differences, in an image of one row
        steps = np.diff(values, prepend=0)
        w.put(0, 1)
        lengths = code_lengths(np.bincount(steps, minlength=LITERALS + LENGTHS))
        put_code(w, lengths)
        _put_single(w, 0), _put_single(w, 0)
        alphas = np.zeros(256, np.int64)
        alphas[0] = alphas[255] = 1  # alpha is 255 first, then unchanged
        if len(values) > 1:
            put_code(w, alphas)
        else:
            _put_single(w, 255)
        _put_single(w, 0)
        green = _codes(lengths)
        for i, s in enumerate(steps.tolist()):
            w.put(int(green[s]), int(lengths[s]) if np.count_nonzero(lengths) > 1 else 0)
            if len(values) > 1:
                w.put(1 if i == 0 else 0, 1)
        per = 8 if len(values) <= 2 else 4 if len(values) <= 4 else 2
        index = np.searchsorted(values, samples)
        padded = np.zeros((height, -(-width // per) * per), np.int64)
        padded[:, :width] = index
        samples = (padded.reshape(height, -1, per) << (np.arange(per) * (8 // per))).sum(axis=2).astype(np.uint8)
        constant = 0
    else:
        constant = 255
        plain = _entropy(samples)
        for mode in (1, 2):
            less = _residual(samples, mode)
            if _entropy(less) < plain - 200:  # bits that the transform's own data take, and some
                w.put(1, 1), w.put(0, 2), w.put(7, 3)  # predictor, in blocks of 512 pixels
                w.put(0, 1)  # its blocks' modes: one symbol for all of them, which takes no bits
                _put_single(w, mode), _put_single(w, 0), _put_single(w, 0), _put_single(w, 255), _put_single(w, 0)
                samples, constant = less, 0
                break
    w.put(0, 1)  # no more transforms
    w.put(0, 1), w.put(0, 1)  # no colour cache, one group of codes
    flat = samples.ravel()
    codes, coded = _body(flat, constant, False)
    if _repetitive(flat):
        other, shorter = _body(flat, constant, True)
        if other.n + len(shorter) < codes.n + len(coded):
            codes, coded = other, shorter
    return _file(np.packbits(np.concatenate([w.bits(), codes.bits(), coded]), bitorder="little").tobytes())


# ---- reading


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise FormatError("the data end too early")
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7)
        if (self.at & 7) + n > 32:
            value = int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class Code:
    """A prefix code as a table over the next ``width`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.one = int(used[0]) if len(used) == 1 else None
        self.symbols = used
        if not len(used):
            raise FormatError("a prefix code without symbols")
        self.width = 0 if self.one is not None else int(lengths.max())
        if self.one is not None:
            return
        if (1 << 15 >> lengths[used]).sum() != 1 << 15:
            raise FormatError("an incomplete or oversubscribed prefix code")
        order, _ = _canonical(lengths)
        room, turned = 1 << (self.width - lengths[order]), _TURNED[self.width]
        self.sym, self.len = np.repeat(order, room)[turned].astype(np.int32), np.repeat(lengths[order], room)[turned].astype(np.int32)
        self._table: list[tuple[int, int]] | None = None

    def read(self, r: BitReader) -> int:
        if self.one is not None:
            return self.one
        if self._table is None:
            self._table = list(zip(self.len.tolist(), self.sym.tolist()))
        first = r.at >> 3
        n, s = self._table[int.from_bytes(r.data[first : first + 4], "little") >> (r.at & 7) & ((1 << self.width) - 1)]
        r.at += n
        if r.at > r.end:
            raise FormatError("the data end too early")
        return s


def _read_code(r: BitReader, size: int) -> Code:
    lengths = np.zeros(max(size, 256), np.int64)
    if r.take(1):
        two = r.take(1)
        lengths[r.take(8 if r.take(1) else 1)] = 1
        if two:
            lengths[r.take(8)] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for k in range(4 + r.take(4)):
        first[LENGTH_ORDER[k]] = r.take(3)
    code, left = Code(first), size
    if r.take(1):
        left = 2 + r.take(2 + 2 * r.take(3))
        if left > size:
            raise FormatError("more code lengths than symbols")
    at, before = 0, 8
    if code.width == 4 and len(code.symbols) == 16 and code.symbols[-1] == 15:  # plain 4-bit lengths, no runs
        n = min(left, size)
        first_byte = r.at >> 3
        value = int.from_bytes(r.data[first_byte : first_byte + n // 2 + 2], "little") >> (r.at & 7)
        raw = np.frombuffer((value & ((1 << 4 * n) - 1)).to_bytes(n // 2 + 1, "little"), np.uint8)
        lengths[:n] = _TURNED[4][np.stack([raw & 15, raw >> 4], axis=1).ravel()[:n]]
        r.at += 4 * n
        if r.at > r.end:
            raise FormatError("the data end too early")
        return Code(lengths)
    while at < size and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
            continue
        n, value = (3 + r.take(2), before) if s == 16 else (3 + r.take(3), 0) if s == 17 else (11 + r.take(7), 0)
        if at + n > size:
            raise FormatError("a run of code lengths goes too far")
        lengths[at : at + n] = value
        at += n
    return Code(lengths)


def _runs(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.take(extra) + 1


def _green_only(r: BitReader, code: Code, n: int) -> np.ndarray:
    """n symbols of one code from the reader's place on, with whole-array operations."""
    if code.one is not None:
        return np.full(n, code.one, np.int32)
    raw = np.frombuffer(r.data[r.at >> 3 : (r.at >> 3) + (n * code.width + 7) // 8 + 2] + b"\0\0\0\0", np.uint8).astype(np.uint32)
    word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    window = np.empty((len(word), 8), np.uint16)
    for k in range(8):
        window[:, k] = (word >> k) & ((1 << code.width) - 1)
    window = window.ravel()
    size = len(window)
    jump = np.arange(size, dtype=np.int32) + code.len[window]
    np.minimum(jump, size - 1, out=jump)
    jumps = [jump]
    for _ in range(6):
        jumps.append(jumps[-1][jumps[-1]])
    far, starts, p = jumps[-1], [], r.at & 7
    for _ in range(-(-n // 64)):
        starts.append(p)
        p = int(far[p])
    at = np.array(starts, np.int32)
    for hop in jumps[5::-1]:
        at = np.stack([at, hop[at]], axis=1).ravel()
    at = at[:n]
    r.at += int(at[-1] + code.len[window[at[-1]]]) - (r.at & 7)
    if r.at > r.end:
        raise FormatError("the data end too early")
    return code.sym[window[at]]


def _green_references(r: BitReader, green: Code, far: Code, n: int, width: int) -> np.ndarray:
    """n samples of a stream of literals and references from the reader's place on, with whole-array operations up to the
    copying of what is referred to."""
    raw = np.frombuffer(r.data[r.at >> 3 :] + bytes(12), np.uint8).astype(np.uint64)
    word = raw[:-7].copy()
    for k in range(1, 8):
        word |= raw[k : len(raw) - 7 + k] << np.uint64(8 * k)
    peek = (word[:, None] >> np.arange(8, dtype=np.uint64)).astype(np.uint32).ravel()  # 32 bits from every bit on
    size = len(peek)

    def look(code: Code, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        bits = peek if at is None else peek[np.minimum(at, size - 1)]
        if code.one is not None:
            return np.full(len(bits), code.one, np.int64), np.zeros(len(bits), np.int64)
        bits = bits & np.uint32((1 << code.width) - 1)
        return code.sym[bits].astype(np.int64), code.len[bits].astype(np.int64)

    def prefixed(symbol: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        low = peek[np.minimum(at, size - 1)].astype(np.int64) & ((1 << extra) - 1)
        return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + low) + 1, at + extra

    symbol, step = look(green, None)
    jump = np.arange(size) + step
    copy = np.flatnonzero(symbol >= LITERALS)
    length, at = prefixed(symbol[copy] - LITERALS, jump[copy])
    d_symbol, d_step = look(far, at)
    distance, at = prefixed(d_symbol, at + d_step)
    jump[copy] = at
    made = np.ones(size, np.int64)
    made[copy] = length
    p, done, places = r.at & 7, 0, []
    jumps, mades = jump.tolist(), made.tolist()
    while done < n:
        if p >= size - 32:
            raise FormatError("the data end too early")
        places.append(p)
        done += mades[p]
        p = jumps[p]
    r.at += p - (r.at & 7)
    if r.at > r.end:
        raise FormatError("the data end too early")
    if done > n:
        raise FormatError("a back-reference leaves the image")
    place = np.array(places)
    start = np.cumsum(made[place]) - made[place]
    out = np.zeros(n, np.uint8)
    literal = symbol[place] < LITERALS
    out[start[literal]] = symbol[place[literal]]
    which = np.searchsorted(copy, place[~literal])
    d = distance[which]
    near = np.array([max(1, x + y * width) for x, y in NEAR])
    d = np.where(d > 120, d - 120, near[np.minimum(d, 120) - 1])
    if (d > start[~literal]).any():
        raise FormatError("a back-reference leaves the image")
    data = memoryview(out)
    for s, k, b in zip(start[~literal].tolist(), length[which].tolist(), d.tolist()):
        if b >= k:
            data[s : s + k] = data[s - b : s - b + k]
        else:  # what is copied goes on into itself
            data[s : s + k] = (bytes(data[s - b : s]) * (k // b + 1))[:k]
    return out


def _entropy_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels (uint32, flat) of an entropy-coded image."""
    bits = r.take(4) if r.take(1) else 0
    if bits > 11:
        raise FormatError("the colour cache is too large")
    which, meta_bits = None, 0
    if main and r.take(1):
        meta_bits = r.take(3) + 2

        wide, high = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
        which = ((_entropy_image(r, wide, high, False) >> 8) & 0xFFFF).reshape(high, wide)
    groups = [[_read_code(r, k) for k in (LITERALS + LENGTHS + (1 << bits if bits else 0), 256, 256, 256, DISTANCES)] for _ in range(int(which.max()) + 1 if which is not None else 1)]
    n = width * height
    first = groups[0]
    if which is None and not bits and first[0].symbols.max() < LITERALS and all(c.one is not None for c in first[1:4]):
        green = _green_only(r, first[0], n).astype(np.uint32)
        return green << 8 | np.uint32(first[3].one << 24 | first[1].one << 16 | first[2].one)
    if which is None and not bits and all(c.one is not None for c in first[1:4]):
        green = _green_references(r, first[0], first[4], n, width).astype(np.uint32)
        return green << 8 | np.uint32(first[3].one << 24 | first[1].one << 16 | first[2].one)
    out, at = [0] * n, 0
    cache, seen = [0] * (1 << bits), 0
    while at < n:
        group = first if which is None else groups[which[(at // width) >> meta_bits, (at % width) >> meta_bits]]
        s = group[0].read(r)
        if s < LITERALS:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < LITERALS + LENGTHS:
            length = _runs(r, s - LITERALS)
            d = _runs(r, group[4].read(r))
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > n:
                raise FormatError("a back-reference leaves the image")
            for _ in range(length):
                out[at] = out[at - d]
                at += 1
        else:
            while seen < at:  # pixels enter the cache before it is asked
                cache[((CACHE_FACTOR * out[seen]) & 0xFFFFFFFF) >> (32 - bits)] = out[seen]
                seen += 1
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) int: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(-1, 4).astype(np.int64)


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((channels & 255).astype(np.uint8)).view("<u4").ravel().astype(np.uint32)


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """Predictions (n, 4) of pixels by one mode from their neighbours."""
    mean = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7):
        return mean(left, top_left if mode == 6 else top)
    if mode in (8, 9):
        return mean(top, top_left if mode == 8 else top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:  # the neighbour nearer to left + top - top_left, over all channels
        to_left, to_top = np.abs(top - top_left).sum(axis=1), np.abs(left - top_left).sum(axis=1)
        return np.where((to_left < to_top)[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        half = mean(left, top)
        return np.clip(half + np.trunc((half - top_left) / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)


def _unpredict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels of residuals.  All neighbours of (x, y) are in fronts x + 2 y before its own, so a front is one step."""
    res = _channels(pixels).reshape(height, width, 4)
    out = np.zeros((height, width, 4), np.int64)
    out[0, 0] = (res[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = (out[0, 0] + np.cumsum(np.concatenate([np.zeros((1, 4), np.int64), res[0, 1:]]), axis=0)) & 255
    out[:, 0] = (out[0, 0] + np.cumsum(np.concatenate([np.zeros((1, 4), np.int64), res[1:, 0]]), axis=0)) & 255
    used = np.unique(modes)
    if len(used) == 1 and used[0] in (1, 2):  # along rows or columns only
        if used[0] == 1:
            out[1:] = (out[1:, :1] + np.cumsum(np.concatenate([np.zeros((height - 1, 1, 4), np.int64), res[1:, 1:]], axis=1), axis=1)) & 255
        else:
            out[:, 1:] = (out[:1, 1:] + np.cumsum(np.concatenate([np.zeros((1, width - 1, 4), np.int64), res[1:, 1:]]), axis=0)) & 255
        return _argb(out.reshape(-1, 4))
    flat, rest = out.reshape(-1, 4), res.reshape(-1, 4)
    for front in range(3, width + 2 * height - 2):
        y = np.arange(max(1, -(-(front - width + 1) // 2)), min(height, (front - 1) // 2 + 1))
        x = front - 2 * y
        i, m = y * width + x, modes[y >> bits, x >> bits]
        # right of the last column comes the row's own first pixel
        left, top, top_right, top_left = flat[i - 1], flat[i - width], flat[i - width + 1], flat[i - width - 1]
        for mode in np.unique(m).tolist():
            k = np.flatnonzero(m == mode)
            flat[i[k]] = (rest[i[k]] + _predict(mode, left[k], top[k], top_right[k], top_left[k])) & 255
    return _argb(flat)


def _uncross(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(pixels).reshape(height, width, 4)
    f = _channels(factors.ravel()).reshape(*factors.shape, 4).astype(np.int64)
    y, x = np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits
    signed = lambda v: ((v & 255) ^ 128) - 128
    moved = lambda t, v: (signed(t) * signed(v)) >> 5
    tile = f[y, x]
    red = c[..., 2] + moved(tile[..., 0], c[..., 1])
    blue = c[..., 0] + moved(tile[..., 1], c[..., 1]) + moved(tile[..., 2], red)
    return _argb(np.stack([blue, c[..., 1], red, c[..., 3]], axis=-1).reshape(-1, 4))


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """``(pixels (height, width) of ARGB uint32, bytes read)`` of the WebP file at the start of ``data``."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise FormatError("not a lossless WebP file")
    total = 8 + struct.unpack("<I", data[4:8])[0]
    r = BitReader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if r.take(8) != SIGNATURE:
        raise FormatError("no VP8L signature")
    width, height = r.take(14) + 1, r.take(14) + 1
    r.take(1)
    if r.take(3):
        raise FormatError("unknown version")
    steps, wide, seen = [], width, set()
    while r.take(1):
        kind = r.take(2)
        if kind in seen:
            raise FormatError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            bits = r.take(3) + 2
            cols, rows = (wide + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            steps.append((kind, wide, bits, _entropy_image(r, cols, rows, False).reshape(rows, cols)))
        elif kind == 2:
            steps.append((kind, wide, 0, None))
        else:
            n = r.take(8) + 1
            table = _argb(np.cumsum(_channels(_entropy_image(r, n, 1, False)), axis=0))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, wide, bits, table))
            wide = (wide + (1 << bits) - 1) >> bits
    pixels = _entropy_image(r, wide, height, True)
    for kind, wide, bits, table in reversed(steps):
        if kind == 0:
            pixels = _unpredict(pixels, wide, height, (table >> 8) & 15, bits)
        elif kind == 1:
            pixels = _uncross(pixels, wide, height, table, bits)
        elif kind == 2:
            c = _channels(pixels)
            c[:, [0, 2]] += c[:, [1]]
            pixels = _argb(c)
        else:
            green = ((pixels >> 8) & 255).astype(np.int64).reshape(height, -1)
            per = 1 << bits
            index = (green[:, :, None] >> (np.arange(per) * (8 // per))) & ((1 << (8 // per)) - 1)
            index = index.reshape(height, -1)[:, :wide]
            pixels = np.where(index < len(table), table[np.minimum(index, len(table) - 1)], 0).astype(np.uint32).ravel()
    return pixels.reshape(height, width), total
