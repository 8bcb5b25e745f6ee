"""The WebP decoder on streams that its own encoder has not made, and the predictor against a scalar reading."""

import struct

import numpy as np
import pytest

from twinlake.llm import webp


class Stream:
    """Bits written by hand: numbers least significant bit first, prefix codes as they are read."""

    def __init__(self):
        self.bits = ""

    def number(self, value, n):
        self.bits += f"{value:0{n}b}"[::-1] if n else ""

    def codes(self, *codes):
        self.bits += "".join(codes)

    def one_symbol(self, symbol):
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            self.number(value, n)

    def one_pixel(self, red, green, blue):
        self.number(0, 1)  # no colour cache
        for symbol in (green, red, blue, 255, 0):
            self.one_symbol(symbol)

    def file(self):
        bits = self.bits + "0" * (-len(self.bits) % 8)
        body = bytes(int(bits[k : k + 8][::-1], 2) for k in range(0, len(bits), 8))
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def by_hand():
    """3 x 2 pixels: predictor 11, cross-colour and subtract-green; a cache of two colours; a copy and a cache hit."""
    s = Stream()
    for value, n in ((0x2F, 8), (2, 14), (1, 14), (1, 1), (0, 3)):
        s.number(value, n)
    for kind, pixel in ((0, (0, 11, 0)), (1, (32, 0, 224))):  # one tile; red to blue 1, green to blue 0, green to red -1
        for value, n in ((1, 1), (kind, 2), (0, 3)):
            s.number(value, n)
        s.one_pixel(*pixel)
    for value, n in ((1, 1), (2, 2), (0, 1)):  # subtract-green, no more transforms
        s.number(value, n)
    for value, n in ((1, 1), (1, 4), (0, 1)):  # colour cache of one bit, one group of codes
        s.number(value, n)
    # Green: symbols 10, 20, 256 (a copy of one pixel) and 281 (second colour of the cache), two bits each.
    for value, n in ((0, 1), (1, 4), (2, 3), (2, 3), (0, 3), (0, 3), (1, 3), (0, 1)):  # lengths of the codes 17, 18, 0, 1, 2
        s.number(value, n)
    for zeros in (10, 9, 138, 97, 24):
        if zeros <= 10:
            s.codes("10")
            s.number(zeros - 3, 3)
        else:
            s.codes("11")
            s.number(zeros - 11, 7)
        if zeros != 138:
            s.codes("0")
    for value, n in ((1, 1), (1, 1), (0, 1), (0, 1), (5, 8)):  # red: 0 and 5
        s.number(value, n)
    for symbol in (1, 0, 1):  # blue, alpha, distance (the pixel to the left)
        s.one_symbol(symbol)
    s.codes("01", "0", "00", "1", "10", "01", "1", "00", "0", "11")
    return s.file()


def test_stream_written_by_hand():
    pixels, size = webp.decode_one(by_hand())
    channels = [[(v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255) for v in row] for row in pixels.tolist()]
    assert channels == [[(255, 0, 20, 21), (255, 5, 30, 37), (255, 10, 40, 53)], [(255, 5, 40, 47), (255, 5, 50, 58), (255, 10, 70, 84)]]
    assert size == len(by_hand())


def guess(mode, left, top, corner, right):
    """The prediction of one pixel, channel by channel in plain numbers."""
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda x: min(255, max(0, x))
    if mode in (0, 14, 15):
        return [255, 0, 0, 0]
    if mode == 11:
        sums = [x + y - z for x, y, z in zip(left, top, corner)]
        return left if sum(abs(s - x) for s, x in zip(sums, left)) < sum(abs(s - x) for s, x in zip(sums, top)) else top
    if mode == 12:
        return [clip(x + y - z) for x, y, z in zip(left, top, corner)]
    if mode == 13:
        return [clip(m + int((m - z) / 2)) for m, z in zip(mean(left, top), corner)]
    return {
        1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top),
        8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
    }[mode]


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (7, 1), (2, 2), (13, 6), (6, 21)])
def test_inverse_predictor_pixel_by_pixel(shape):
    rng = np.random.default_rng(sum(shape))
    height, width = shape
    residuals = rng.integers(0, 256, (height, width, 4))
    modes = rng.integers(0, 16, (-(-height // 4), -(-width // 4)))
    rows = []
    for y in range(height):
        row = []
        rows.append(row)
        for x in range(width):
            if x and y:
                wanted = guess(int(modes[y // 4, x // 4]), row[x - 1], rows[y - 1][x], rows[y - 1][x - 1], rows[y - 1][x + 1] if x + 1 < width else row[0])
            else:
                wanted = row[x - 1] if x else rows[y - 1][0] if y else [255, 0, 0, 0]
            row.append([(int(r) + w) % 256 for r, w in zip(residuals[y, x], wanted)])
    packed = np.array([[r[0] << 24 | r[1] << 16 | r[2] << 8 | r[3] for r in row] for row in residuals.tolist()], np.uint32)
    expected = [[r[0] << 24 | r[1] << 16 | r[2] << 8 | r[3] for r in row] for row in rows]
    assert webp._predict(packed, modes.astype(np.uint32), 2, True).tolist() == expected
    assert webp._predict(np.array(expected, np.uint32), modes.astype(np.uint32), 2, False).tolist() == packed.tolist()
