"""Lossless WebP in numpy: a decoder of the whole bit stream and an encoder that can use each of its tools.

Pixels are uint32 ARGB arrays of shape (height, width). Images whose pixels are told apart by the green code alone
(palette and grey-level images, one prefix-code group, no colour cache) are decoded with array operations; all
others by a loop over symbols. Both paths read the same stream and give the same pixels.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed values of the format: the order of code-length code lengths.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (x, y) offsets of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_HASH = 0x1E35A7BD
_M = 0xFFFFFFFF


class Bits:
    """Reads a stream of bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0

    def take(self, n: int) -> int:
        k = self.at >> 3
        value = int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)


class BitWriter:
    """Collects (value, number of bits), singly or as arrays."""

    def __init__(self) -> None:
        self.values, self.sizes, self.some = [], [], []

    def put(self, value: int, n: int) -> None:
        self.some.append((value, n))

    def _flush(self) -> None:
        if self.some:
            both = np.array(self.some, np.int64)
            self.values.append(both[:, 0])
            self.sizes.append(both[:, 1])
            self.some = []

    def put_many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.sizes).astype(np.int64)
        ends = np.cumsum(sizes)
        at = ends - sizes
        total, word = int(ends[-1]), at >> 5
        wide = values << (at & 31).astype(np.uint64)
        n = (total >> 5) + 2  # bits never overlap, so sums of 32-bit parts are exact as doubles
        words = np.bincount(word, (wide & np.uint64(_M)).astype(np.float64), n)
        words[1:] += np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)[:-1]
        return words.astype(np.uint32).astype("<u4").tobytes()[: (total + 7) // 8]


class Code:
    """A prefix code for decoding: a table of symbol << 4 | length, by the next `width` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self._single(int(used[0]) if len(used) else 0)
            return
        self.only, self.width = None, int(lengths.max())
        self.table = np.zeros(1 << self.width, np.int32)
        codes = reversed_codes(lengths)
        for s, c, n in zip(used.tolist(), codes[used].tolist(), lengths[used].tolist()):
            self.table[c :: 1 << n] = s << 4 | n

    def _single(self, symbol: int) -> None:
        self.only, self.width, self.table = symbol, 0, np.array([symbol << 4], np.int32)

    @classmethod
    def single(cls, symbol: int) -> Code:
        code = cls.__new__(cls)
        code._single(symbol)
        return code

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        k = bits.at >> 3
        entry = int(self.table[int.from_bytes(bits.data[k : k + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)])
        bits.at += entry & 15
        return entry >> 4


_REVERSED = [int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)]


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits in the order in which they are read."""
    codes, code, before = np.zeros(len(lengths), np.int64), 0, 0
    used = np.flatnonzero(lengths)
    order, values = sorted(zip(lengths[used].tolist(), used.tolist())), []
    for n, _ in order:
        code <<= n - before
        before = n
        values.append(_REVERSED[code] >> (15 - n))
        code += 1
    codes[[s for _, s in order]] = values
    return codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; frequencies are flattened until they fit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    weight = counts[used].tolist()
    while True:
        heap = [(w, k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        up, n = [0] * (2 * len(weight) - 1), len(weight)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, (a[0] + b[0], n))
            up[a[1]] = up[b[1]] = n
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        weight = [w // 2 + 1 for w in weight]


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number, of a length or distance from 1."""
    if value <= 4:
        return value - 1, 0, 0
    d = value - 1
    h = d.bit_length() - 1
    return 2 * h + (d >> (h - 1) & 1), d & ((1 << (h - 1)) - 1), h - 1


def _value(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.take(n) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# Decoding


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.take(1):
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        if not two:
            return Code.single(first)
        lengths = np.zeros(alphabet, np.int64)
        lengths[[first, bits.take(8)]] = 1
        return Code(lengths)
    lengths = np.zeros(alphabet, np.int64)
    of_lengths = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.take(4)]:
        of_lengths[k] = bits.take(3)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    code, at, last = Code(of_lengths), 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        elif s == 16:
            n = 3 + bits.take(2)
            lengths[at : at + n] = last
            at += n
        else:
            at += 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
    return Code(lengths)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups_at, block = None, 0
    if main and bits.take(1):
        block = bits.take(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups_at = (_read_pixels(bits, across, (height + (1 << block) - 1) >> block, False) >> np.uint32(8)) & np.uint32(0xFFFF)
    groups = []
    for _ in range(int(groups_at.max()) + 1 if groups_at is not None else 1):
        groups.append([_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)])
    n = width * height
    if len(groups) == 1 and not cache_bits and all(c.only is not None for c in groups[0][1:4]):
        return _read_green(bits, groups[0], width, n).reshape(height, width)
    out, cache, at = [0] * n, [0] * (1 << cache_bits), 0
    shift = 32 - cache_bits
    while at < n:
        green, red, blue, alpha, far = groups[int(groups_at[(at // width) >> block, (at % width) >> block])] if groups_at is not None else groups[0]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            done = [alpha.read(bits) << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            length = _value(s - 256, bits)
            back = _distance(_value(far.read(bits), bits), width)
            done = [out[at - back + k % back] for k in range(length)] if back < length else out[at - back : at - back + length]
        else:
            done = [cache[s - 280]]
        out[at : at + len(done)] = done
        at += len(done)
        if cache_bits:
            for p in done:
                cache[(_HASH * p & _M) >> shift] = p
    return np.array(out[:n], np.uint32).reshape(height, width)


def _read_green(bits: Bits, codes: list[Code], width: int, n: int) -> np.ndarray:
    """Symbols of an image with a code for green alone.

    The symbol and the next position are looked up for every bit position at once; runs of literals then follow
    the chain of next positions, eight at a step.
    """
    green, far = codes[0], codes[4]
    base = np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only)
    out, done = np.zeros(n, np.uint16), 0
    if green.only is not None and green.only < 256:
        out[:] = green.only
        return base | out.astype(np.uint32) << np.uint32(8)
    start = bits.at & ~7
    raw = np.frombuffer(bits.data, np.uint8)[start >> 3 :].astype(np.uint32)
    wide = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    entry = green.table[((wide[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.width) - 1)).ravel()]
    here = np.arange(len(entry), dtype=np.int32)
    after = np.minimum(here + (entry & 15), np.int32(len(entry) - 1))
    symbol = (entry >> 4).astype(np.uint16)
    copies = symbol >= 256
    after[copies] = here[copies]  # a copy ends a run of literals
    two = after[after]
    four = two[two]
    eight = memoryview(four[four])
    at = bits.at - start
    while done < n:
        steps, p, most = [], at, (n - done + 7) >> 3
        while len(steps) < most:
            steps.append(p)
            q = eight[p]
            if q == p:
                break
            p = q
        run = np.empty((len(steps), 8), np.int64)
        run[:, 0] = steps
        for k in range(1, 8):
            run[:, k] = after[run[:, k - 1]]
        run = run.ravel()[: n - done]
        stop = np.flatnonzero(copies[run[-16:]])  # a copy met fills what is left of its step and the step after
        if len(stop):
            run = run[: max(0, len(run) - 16) + int(stop[0])]
        out[done : done + len(run)] = symbol[run]
        done += len(run)
        at = int(run[-1]) + int(entry[run[-1]] & 15) if len(run) else at
        if done < n:
            bits.at = start + at + int(entry[at] & 15)
            length = min(_value(int(symbol[at]) - 256, bits), n - done)
            back = _distance(_value(far.read(bits), bits), width)
            if back < length:
                out[done : done + length] = np.resize(out[done - back : done], length)
            else:
                out[done : done + length] = out[done - back : done - back + length]
            done += length
            at = bits.at - start
    bits.at = start + at
    return base | out.astype(np.uint32) << np.uint32(8)


def _split(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> np.uint32(24), p >> np.uint32(16) & np.uint32(255), p >> np.uint32(8) & np.uint32(255), p & np.uint32(255)], -1).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left, top, top_left, top_right):
    """The prediction from neighbours (channel arrays)."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        toward_left = np.abs(top - top_left).sum(-1, keepdims=True) < np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(toward_left, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        half = m - top_left
        return np.clip(m + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    return (
        lambda: np.array([255, 0, 0, 0]), lambda: left, lambda: top, lambda: top_right, lambda: top_left, lambda: mean(mean(left, top_right), top), lambda: mean(left, top_left),
        lambda: mean(left, top), lambda: mean(top_left, top), lambda: mean(top, top_right), lambda: mean(mean(left, top_left), mean(top, top_right)),
    )[mode]()


def _predict(p: np.ndarray, modes: np.ndarray, block: int, invert: bool) -> np.ndarray:
    """Adds predictions to residuals (invert) or takes them from pixels.

    A pixel needs its left, upper and upper right neighbours, so all pixels with equal x + 2 y are done at once.
    """
    given = _split(p)
    height, width = p.shape
    mode = np.repeat(np.repeat(modes & np.uint32(15), 1 << block, 0), 1 << block, 1)[:height, :width].astype(np.int64)
    mode[mode > 13] = 0
    mode[0], mode[:, 0], mode[0, 0] = 1, 2, 0  # the edges have modes of their own
    full = np.zeros_like(given) if invert else given
    out = np.zeros_like(given)
    for t in range(width + 2 * (height - 1)):
        y = np.arange(max(0, (t - width + 2) // 2), min(height - 1, t // 2) + 1)
        x = t - 2 * y
        inside = x + 1 < width  # behind the last column stands the row's own first pixel
        around = full[y, x - 1], full[y - 1, x], full[y - 1, x - 1], full[y - inside, np.where(inside, x + 1, 0)]
        here, guess = mode[y, x], np.zeros((len(y), 4), np.int32)
        for m in np.unique(here).tolist():
            mine = here == m
            guess[mine] = _predicted(m, *(c[mine] for c in around))
        done = (given[y, x] + guess if invert else given[y, x] - guess) & 255
        out[y, x] = done
        if invert:
            full[y, x] = done
    return _join(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int32) ^ 128) - 128


def _cross(p: np.ndarray, by: np.ndarray, block: int, invert: bool) -> np.ndarray:
    """Red and blue by the products of multipliers (an image of blocks) and green and red."""
    c = _split(p)
    m = np.repeat(np.repeat(by, 1 << block, 0), 1 << block, 1)[: p.shape[0], : p.shape[1]]
    m = _split(m)
    share = lambda t, v: _signed(t & 255) * _signed(v & 255) >> 5
    sign = 1 if invert else -1
    red = c[..., 1] + sign * share(m[..., 3], c[..., 2])
    blue = c[..., 3] + sign * share(m[..., 2], c[..., 2]) + sign * share(m[..., 1], red if invert else c[..., 1])
    return _join(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def decode_one(data: bytes) -> tuple[np.ndarray, int]:
    """The pixels of the first image in `data`, and the length of its file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = 8 + struct.unpack("<I", data[4:8])[0]
    bits = Bits(data[20:size])
    if bits.take(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(4)
    transforms, across = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.take(3) + 2
            step = 1 << block
            transforms.append((kind, block, across, _read_pixels(bits, (across + step - 1) >> block, (height + step - 1) >> block, False)))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            table = _join(np.cumsum(_split(_read_pixels(bits, n, 1, False)[0]), 0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, pack, across, table))
            across = (across + (1 << pack) - 1) >> pack
        else:
            transforms.append((kind, 0, across, None))
    p = _read_pixels(bits, across, height, True)
    for kind, block, wide, own in reversed(transforms):
        if kind == PREDICTOR:
            p = _predict(p, own >> np.uint32(8) & np.uint32(255), block, True)
        elif kind == CROSS_COLOUR:
            p = _cross(p, own, block, True)
        elif kind == SUBTRACT_GREEN:
            green = p >> np.uint32(8) & np.uint32(255)
            p = p & np.uint32(0xFF00FF00) | (p + (green << np.uint32(16))) & np.uint32(0xFF0000) | (p + green) & np.uint32(255)
        else:
            index = p >> np.uint32(8) & np.uint32(255)
            if block:
                each = 8 >> block
                index = (index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * np.uint32(each)) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(own)] = own
            p = table[index]
    return p, size + (size & 1)


# Encoding


_NONE = np.zeros(256, np.int64)


def _write_single(bits: BitWriter, symbol: int) -> None:
    """A code of one symbol."""
    bits.put(1 | (symbol > 1) << 2 | symbol << 3, 11 if symbol > 1 else 4)


def _write_code(bits: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2 and (not used or used[0] < 256):
        _write_single(bits, used[0] if used else 0)
        return
    if len(used) == 2 and used[1] < 256:
        bits.put(3 | (used[0] > 1) << 2 | used[0] << 3, 11 if used[0] > 1 else 4)
        bits.put(used[1], 8)
        return
    tokens, at = [], 0
    for s in used:
        zeros = s - at
        while zeros:
            if zeros < 3:
                n, token = 1, (0, 0, 0)
            else:
                n = min(zeros, 138)
                token = (17, n - 3, 3) if n <= 10 else (18, n - 11, 7)
            tokens.append(token)
            zeros -= n
        tokens.append((int(lengths[s]), 0, 0))
        at = s + 1
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    kept = [int(own[k]) for k in LENGTH_ORDER]
    while len(kept) > 4 and not kept[-1]:
        kept.pop()
    bits.put(0, 1)
    bits.put(len(kept) - 4, 4)
    for n in kept:
        bits.put(n, 3)
    bits.put(1, 1)  # the number of tokens is given: zeros at the end are left out
    extra = max(2, (len(tokens) - 2).bit_length())
    extra += extra & 1
    bits.put((extra - 2) // 2, 3)
    bits.put(max(0, len(tokens) - 2), extra)
    tokens += [(17, 0, 3)] * (2 - len(tokens))
    codes, free = reversed_codes(own), np.count_nonzero(own) == 1
    for s, value, n in tokens:
        bits.put(int(codes[s]), 0 if free else int(own[s]))
        if n:
            bits.put(value, n)


def _write_pixels(bits: BitWriter, p: np.ndarray, width: int, main: bool, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0) -> None:
    """The pixels (flat), with copies (start, length, distance) by start; other pixels are literals or cache hits."""
    bits.put(cache_bits > 0, 1)
    if cache_bits:
        bits.put(cache_bits, 4)
    if main:
        bits.put(0, 1)
    green = (p >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    red, blue, alpha = ((p >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24))
    literal = np.ones(len(p), bool)
    tails: list[tuple[int, list[tuple[int, int, int]]]] = []  # (pixel, [(symbol, extra, bits)] for length and distance)
    for start, length, back in copies:
        literal[start : start + length] = False
        for at in range(start, start + length, 4096):
            n = min(4096, start + length - at)
            tails.append((at, [_prefixed(n), _prefixed(2 if back == 1 else 1 if back == width else back + 120)]))
    if cache_bits:
        cache, shift = np.full(1 << cache_bits, -1, np.int64), 32 - cache_bits
        cache[:] = 0
        for k, v in enumerate(p.tolist()):
            slot = (_HASH * v & _M) >> shift
            if literal[k] and cache[slot] == v:
                green[k] = 280 + slot
            cache[slot] = v
    places = np.flatnonzero(literal)
    g = green[places]
    plain = places[g < 256]
    counts = np.bincount(g, minlength=280 + (1 << cache_bits if cache_bits else 0))
    far = np.zeros(40, np.int64)
    for _, ((s, _, _), (d, _, _)) in tails:
        counts[256 + s] += 1
        far[d] += 1
    codes, sizes = [], []
    for c in (counts, red, blue, alpha, far):
        if c is not counts and c is not far:
            if not len(plain) or (c[plain[0]] == c[plain]).all():  # one symbol: no bits for it
                _write_single(bits, int(c[plain[0]]) if len(plain) else 0)
                codes.append(_NONE)
                sizes.append(_NONE)
                continue
            c = np.bincount(c[plain], minlength=256)
        n = code_lengths(c, 12)
        _write_code(bits, n)
        codes.append(reversed_codes(n))
        sizes.append(n if (n > 0).sum() > 1 else np.zeros_like(n))
    values, size = codes[0][g], sizes[0][g]
    if not all(s is _NONE for s in sizes[1:4]):
        other = g < 256
        columns = [(values, size)] + [(np.where(other, codes[k][c[places]], 0), np.where(other, sizes[k][c[places]], 0)) for k, c in ((1, red), (2, blue), (3, alpha))]
        values, size = np.stack([v for v, _ in columns], 1), np.stack([n for _, n in columns], 1)
    done = 0
    for at, ((s, extra, n), (d, more, m)) in tails:
        upto = int(np.searchsorted(places, at))
        bits.put_many(values[done:upto].ravel(), size[done:upto].ravel())
        done = upto
        bits.put(int(codes[0][256 + s]), int(sizes[0][256 + s]))
        bits.put(extra, n)
        bits.put(int(codes[4][d]), int(sizes[4][d]))
        bits.put(more, m)
    bits.put_many(values[done:].ravel(), size[done:].ravel())


def _file(bits: BitWriter) -> bytes:
    body = bits.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _head(width: int, height: int, alpha: bool) -> BitWriter:
    bits = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        bits.put(value, n)
    return bits


def encode(p: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, block: int = 3) -> bytes:
    """A file with the tools asked for: a prediction mode, (red to blue, green to blue, green to red), and so on."""
    height, width = p.shape
    bits = _head(width, height, bool((p >> np.uint32(24) != 255).any()))
    tiles = (-(-height // (1 << block)), -(-width // (1 << block)))
    if predictor is not None:
        modes = np.full(tiles, predictor, np.uint32)
        p = _predict(p, modes, block, False)
        for value, n in ((1, 1), (PREDICTOR, 2), (block - 2, 3)):
            bits.put(value, n)
        _write_pixels(bits, (modes << np.uint32(8) | np.uint32(0xFF000000)).ravel(), tiles[1], False)
    if cross:
        by = np.full(tiles, 255 << 24 | (cross[0] & 255) << 16 | (cross[1] & 255) << 8 | cross[2] & 255, np.uint32)
        p = _cross(p, by, block, False)
        for value, n in ((1, 1), (CROSS_COLOUR, 2), (block - 2, 3)):
            bits.put(value, n)
        _write_pixels(bits, by.ravel(), tiles[1], False)
    if subtract_green:
        c = _split(p)
        p = _join(np.stack([c[..., 0], c[..., 1] - c[..., 2], c[..., 2], c[..., 3] - c[..., 2]], -1))
        bits.put(1, 1)
        bits.put(SUBTRACT_GREEN, 2)
    copies: list[tuple[int, int, int]] = []
    if palette:
        table, index = np.unique(p, return_inverse=True)
        p, width = _put_palette(bits, table, index.reshape(height, -1))
    bits.put(0, 1)
    flat = p.ravel()
    same = np.flatnonzero(np.diff(np.concatenate([[0], (flat[1:] == flat[:-1]).astype(np.int8), [0]])))
    copies = [(int(a) + 1, int(b - a), 1) for a, b in same.reshape(-1, 2) if b - a >= 8]
    _write_pixels(bits, flat, width, True, copies, cache_bits)
    return _file(bits)


def _put_palette(bits: BitWriter, table: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, int]:
    """Writes the palette; the pixels of the index image and its width (several indices to a pixel if few colours)."""
    n = len(table)
    bits.put(1, 1)
    bits.put(PALETTE, 2)
    bits.put(n - 1, 8)
    c = _split(table)
    _write_pixels(bits, _join(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int32))), n, False)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    if pack:
        each, per = 8 >> pack, 1 << pack
        index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(index.shape[0], -1, per)
        index = (index << (np.arange(per) * each)).sum(-1)
    return index.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), index.shape[1]


def repeats(raw: np.ndarray, least: int = 40) -> list[tuple[int, int, int]]:
    """Long repeats (start, length, distance), from anchors whose next 8 bytes have occurred before.

    Every position whose 8 bytes hash to 0 modulo 16 is an anchor, so a repeat of some length holds one almost surely.
    """
    n = len(raw) - 7
    if n < 2 * least:
        return []
    data, wide = raw.tobytes(), np.empty(n, np.uint64)
    for k in range(8):
        part = np.frombuffer(data, "<u8", (len(data) - k) // 8, k)
        wide[k::8] = part[: len(wide[k::8])]
    anchors = np.flatnonzero((wide * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60) == 0)
    key = wide[anchors]
    order = np.argsort(key, kind="stable")
    twice = np.flatnonzero(key[order][1:] == key[order][:-1])
    found, done = [], 0
    for a, b in sorted(zip(anchors[order[twice + 1]].tolist(), anchors[order[twice]].tolist())):
        if a < done + 8:
            continue
        size, step = 8, 64
        while a + size < len(data):
            x, y = data[a + size : a + size + step], data[b + size : b + size + step]
            if x == y[: len(x)]:
                size += len(x)
                continue
            size += next(k for k in range(len(x)) if x[k] != y[k])
            break
        back = 0
        while a - back > done and b - back > 0 and data[a - back - 1] == data[b - back - 1]:
            back += 1
        if size + back >= least:
            found.append((a - back, size + back, a - b))
            done = a + size
    return found


def encode_samples(samples: np.ndarray) -> bytes:
    """A file of 8-bit samples, held by the green channel; few values become a palette with several to a pixel, repeats back-references."""
    height, width = samples.shape
    flat = samples.ravel()
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    bits = _head(width, height, False)
    if len(used) <= 16:
        place = np.zeros(256, np.uint32)
        place[used] = np.arange(len(used))
        p, across = _put_palette(bits, used.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), place[samples])
    else:
        p, across = samples.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), width
    bits.put(0, 1)
    pixels = p.ravel()
    end = len(pixels) - 1
    change = np.flatnonzero(pixels != pixels[-1])
    tail = int(change[-1]) + 2 if len(change) else 1  # padding at the end: one value over and over
    copies = [c for c in (repeats(flat) if across == width else []) if c[0] + c[1] <= tail]
    if end - tail >= 8:
        copies.append((tail, end - tail + 1, 1))
    _write_pixels(bits, pixels, across, True, copies)
    return _file(bits)


def decode_samples(data: bytes) -> np.ndarray:
    """The samples of one or several files in a row, one below the other."""
    parts, at = [], 0
    while at < len(data):
        p, size = decode_one(data[at:] if at else data)
        parts.append((p >> np.uint32(8)).astype(np.uint8))
        at += size
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
