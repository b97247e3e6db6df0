"""Media columns in lossless WebP: gray images of bytes written, any lossless image read back to pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the format: order of the code lengths' own code, and offsets (x, y) of short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

#: Longest code that the writer uses and that images are read side by side with.
FAST_BITS = 12
_REVERSED = np.array([int(f"{i:0{FAST_BITS}b}"[::-1], 2) for i in range(1 << FAST_BITS)])


#: Samples of an image at most: an image 64 wide holds them exactly.
PART = 64 * 16384


class BadImage(ValueError):
    """The bytes are no lossless WebP image."""


# ---- prefix codes


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code for the counts, none above `most`: where one is, counts are flattened and the
    code is built anew. One symbol alone gets length 0."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        return out
    weights = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable").tolist()
        w = weights[order].tolist()
        n = len(w)
        parent, inner = [0] * (2 * n - 1), []
        i = j = 0
        for new in range(n, 2 * n - 1):
            pair = 0
            for _ in range(2):
                if j >= len(inner) or i < n and w[i] <= inner[j]:
                    pair += w[i]
                    parent[i] = new
                    i += 1
                else:
                    pair += inner[j]
                    parent[n + j] = new
                    j += 1
            inner.append(pair)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[used[order]] = depth[:n]
            return out
        weights = (weights + 3) // 4 + 1


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of the lengths, first bit lowest."""
    out = np.zeros(len(lengths), np.int64)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        if n := int(lengths[s]):
            code <<= n - last
            last = n
            out[s] = int(f"{code:0{n}b}"[::-1], 2)
            code += 1
    return out


def lookup_table(lengths: np.ndarray, bits: int) -> np.ndarray:
    """By the next `bits` bits: symbol * 16 + length of its code."""
    used = np.nonzero(lengths)[0]
    used = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (bits - lengths[used])
    if spans.sum() != 1 << bits:
        raise BadImage("incomplete prefix code")
    flat = np.repeat(used * 16 + lengths[used], spans)
    turn = _REVERSED if bits == FAST_BITS else np.array([int(f"{i:0{bits}b}"[::-1], 2) for i in range(1 << bits)])
    return flat[turn]


# ---- writing


class BitWriter:
    """Bits from the lowest of each byte on."""

    def __init__(self) -> None:
        self.value = self.count = 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.count
        self.count += bits


def put_lengths(out: BitWriter, lengths: list[int]) -> None:
    """A prefix code's lengths, at least two of them not zero, in the normal form of the format."""
    last = max(i for i, n in enumerate(lengths) if n)
    items: list[tuple[int, int, int]] = []
    i = 0
    while i <= last:
        if lengths[i]:
            items.append((lengths[i], 0, 0))
            i += 1
            continue
        j = i
        while not lengths[j]:
            j += 1
        while j - i >= 11:
            run = min(j - i, 138)
            items.append((18, run - 11, 7))
            i += run
        if j - i >= 3:
            items.append((17, j - i - 3, 3))
        else:
            items += [(0, 0, 0)] * (j - i)
        i = j
    counts = np.bincount([x[0] for x in items], minlength=19)
    own = code_lengths(counts, 7)
    if not own.any():  # one symbol: give it a partner, as a code of no bits is not worth a special case
        counts[0 if counts.argmax() else 1] += 1
        own = code_lengths(counts, 7)
    codes = canonical_codes(own)
    n = max(k for k, s in enumerate(LENGTH_ORDER) if own[s]) + 1
    out.put(0, 1)
    out.put(max(n, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(n, 4)]:
        out.put(int(own[s]), 3)
    if len(items) < 2 or last == len(lengths) - 1:
        out.put(0, 1)
        items += [(0, 0, 0)] * 0
    else:
        bits = max(2, (len(items) - 2).bit_length() + 1 & ~1)
        out.put(1, 1)
        out.put((bits - 2) // 2, 3)
        out.put(len(items) - 2, bits)
    own_l, codes_l = own.tolist(), codes.tolist()
    for s, extra, bits in items:
        out.put(codes_l[s], own_l[s])
        out.put(extra, bits)


def put_symbol(out: BitWriter, symbol: int) -> None:
    """A code of one symbol, below 256."""
    wide = symbol > 1
    out.put(1, 1)
    out.put(0, 1)
    out.put(int(wide), 1)
    out.put(symbol, 8 if wide else 1)


def container(data: bytes) -> bytes:
    pad = b"\0" * (len(data) % 2)
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def shape_of(samples: int) -> tuple[int, int]:
    """Width and height of the image of so many samples, PART at most: 64 wide."""
    return 64, max(1, -(-samples // 64))


def padded(payload: bytes) -> bytes:
    """payload with zeros to a positive multiple of 64."""
    return payload + b"\0" * (-len(payload) % 64 if payload else 64)


def write_gray(samples: bytes) -> bytes:
    """A lossless WebP image whose red, green and blue are the samples, of a positive multiple of 64 up to PART: green alone is
    coded, by a prefix code of its own, and the subtract-green transform makes the others of it."""
    raw = np.frombuffer(samples, np.uint8)
    out = _begun(len(samples))
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 3)  # no further transform, colour cache or meta codes
    lengths, codes = _put_code(out, np.bincount(raw, minlength=280), FAST_BITS)
    for symbol in (0, 0, 255, 0):
        put_symbol(out, symbol)
    return container(_filled(out, codes[raw], lengths[raw]))


def write_compact(samples: bytes, palette: bool) -> bytes:
    """The same image by back-references, whose distances and lengths have prefix codes too; with palette, over the places of
    16 values at most in a palette, several to a pixel."""
    out = _begun(len(samples))
    if palette:
        values, raw = np.unique(np.frombuffer(samples, np.uint8), return_inverse=True)
        each = 8 if len(values) <= 2 else 4 if len(values) <= 4 else 2
        out.put(1 | PALETTE << 1, 3)
        out.put(len(values) - 1, 8)
        steps = np.diff(values.astype(np.int64), prepend=0) & 255
        out.put(0, 1)
        coded = [_put_code(out, np.bincount(steps, minlength=n), 15) for n in (280, 256, 256)]
        solid = [255, *[0] * (len(values) - 1)]  # differences of alpha
        coded.append(_put_code(out, np.bincount(solid, minlength=256), 15))
        put_symbol(out, 0)
        for step, alpha in zip(steps.tolist(), solid, strict=True):
            for (n, c), v in zip(coded, (step, step, step, alpha), strict=True):
                out.put(int(c[v]), int(n[v]))
        samples = (raw.reshape(-1, each).astype(np.uint8) << (np.arange(each, dtype=np.uint8) * (8 // each))).sum(axis=1, dtype=np.uint8).tobytes()
    else:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 3)
    kind, length, distance = copies_of(samples)
    copied = np.nonzero(kind < 0)[0]
    size, more, extra = _prefixed(length[copied])
    far, far_more, far_extra = _prefixed(distance[copied] + len(NEAR))
    green = kind.copy()
    green[copied] = 256 + size
    lengths, codes = _put_code(out, np.bincount(green, minlength=280), 15)
    for symbol in (0, 0, 255):
        put_symbol(out, symbol)
    far_lengths, far_codes = _put_code(out, np.bincount(far, minlength=40), 15)
    # Four pieces an item: its symbol, and of copies the rest of the length, the distance's symbol and its rest.
    value, bits = np.zeros((2, len(kind), 4), np.int64)
    value[:, 0], bits[:, 0] = codes[green], lengths[green]
    value[copied, 1:] = np.stack([extra, far_codes[far], far_extra], axis=1)
    bits[copied, 1:] = np.stack([more, far_lengths[far], far_more], axis=1)
    return container(_filled(out, value.ravel(), bits.ravel()))


def copies_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, length, distance) of the items that data is written with: kind is a byte, or -1 for a copy of `length` bytes
    from `distance` back. Runs are sought where six bytes were met before."""
    n, at = len(data), 0
    met: dict[bytes, int] = {}
    kind, length, distance = [], [], []
    while at < n:
        gram = data[at : at + 6]
        before = met.get(gram) if len(gram) == 6 else None
        met[gram] = at
        if before is None:
            kind.append(data[at]), length.append(1), distance.append(0)
            at += 1
            continue
        run, most = 6, min(4096, n - at)
        while run < most and data[before + run : before + run + 32] == data[at + run : at + run + 32]:
            run += 32
        run = min(run, most)
        while run < most and data[before + run] == data[at + run]:
            run += 1
        kind.append(-1), length.append(run), distance.append(at - before)
        for k in range(at + 5, at + run - 6, 11):
            met[data[k : k + 6]] = k
        at += run
    return np.array(kind), np.array(length), np.array(distance)


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols of lengths or distances from 1, the number of bits that follow each, and these."""
    v = values.astype(np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    more = np.maximum(top - 1, 0)
    symbol = np.where(v < 4, v, 2 * top + ((v >> more) & 1))
    more = np.where(v < 4, 0, more)
    return symbol, more, v & ((1 << more) - 1)


def _begun(samples: int) -> BitWriter:
    width, height = shape_of(samples)
    out = BitWriter()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4)):
        out.put(value, bits)
    return out


def _put_code(out: BitWriter, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the prefix code of the counts; its lengths and codes. One symbol alone, below 256, takes no bits."""
    lengths = code_lengths(counts, most)
    if lengths.any():
        put_lengths(out, lengths.tolist())
    else:
        put_symbol(out, int(counts.argmax()))
    return lengths, canonical_codes(lengths)


def _filled(head: BitWriter, value: np.ndarray, bits: np.ndarray) -> bytes:
    """The head's bits and then those of the values, 31 of each at most."""
    start = head.value.to_bytes((head.count + 7) // 8, "little")
    ends = np.cumsum(bits, dtype=np.int64)
    total = int(ends[-1])
    if not total:
        return start
    at = ends - bits + (head.count & 7)
    shifted = value.astype(np.uint64) << (at & 31).astype(np.uint64)
    word = at >> 5
    first = np.concatenate([[0], np.nonzero(np.diff(word))[0] + 1])
    low = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    high = np.add.reduceat(shifted >> np.uint64(32), first)
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] += low
    words[word[first] + 1] += high
    body = words.astype("<u4").tobytes()[: ((head.count & 7) + total + 7) // 8]
    if head.count & 7:
        body = bytes([body[0] | start[-1]]) + body[1:]
        start = start[:-1]
    return start + body


def write_payload(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 as images of PART samples at most, one after another: its length is that of
    their samples. Each is written in the least of the ways that may pay: literals; back-references, if a quick look
    finds half of the bytes again; a palette, if there are 16 values at most."""
    out = []
    for at in range(0, len(payload), PART):
        part = payload[at : at + PART]
        ways = [write_gray(part)]
        few = 1 < len(set(part[:: max(1, len(part) // 64)])) <= 16 and 1 < len(set(part)) <= 16
        again = 2 * len(zlib.compress(part, 1)) < len(ways[0])
        if few or again:
            ways.append(write_compact(part, few))
        out.append(min(ways, key=len))
    return b"".join(out)


def images_of(media: bytes) -> list[bytes]:
    """The images that stand one after another."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = max(end, at + 12)
    return out


def read_payloads(media: list[bytes | None]) -> list[bytes | None]:
    """The samples of each of the media's images, one after another; None for null media and damaged ones."""
    parts = [[] if m is None else images_of(m) for m in media]
    got = iter(read_images([x for own in parts for x in own]))
    joined = [[next(got) for _ in own] for own in parts]
    return [b"".join(x[3] for x in own) if own and None not in own else None for own in joined]


# ---- reading


class BitReader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def get(self, bits: int) -> int:
        if not bits:
            return 0
        at = self.at
        self.at = at + bits
        if self.at > 8 * len(self.data):
            raise BadImage("the data end early")
        return int.from_bytes(self.data[at >> 3 : (at + bits + 7) >> 3], "little") >> (at & 7) & ((1 << bits) - 1)


class PrefixCode:
    """A prefix code and how to read its symbols."""

    def __init__(self, lengths: np.ndarray, only: int | None = None) -> None:
        self.lengths, self.only = lengths, only
        used = np.nonzero(lengths)[0]
        if only is None and len(used) == 1:
            self.only = int(used[0])
        if self.only is None:
            if not len(used):
                raise BadImage("empty prefix code")
            self.bits = int(lengths.max())
            self._table: list[int] | None = None

    def read(self, bits: BitReader) -> int:
        if self.only is not None:
            return self.only
        if self._table is None:
            self._table = lookup_table(self.lengths, self.bits).tolist()
        at, data = bits.at, bits.data
        entry = self._table[
            int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.bits) - 1)
        ]
        bits.at = at + (entry & 15)
        if bits.at > 8 * len(data):
            raise BadImage("the data end early")
        return entry >> 4


def read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.int64)
    if bits.get(1):
        two, wide = bits.get(1), bits.get(1)
        first = bits.get(8 if wide else 1)
        if not two:
            return PrefixCode(lengths, first)
        second = bits.get(8)
        lengths[[first, second]] = 1
        return PrefixCode(lengths, first if first == second else None)
    own = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: 4 + bits.get(4)]:
        own[s] = bits.get(3)
    code = PrefixCode(own)
    left = alphabet if not bits.get(1) else 2 + bits.get(2 + 2 * bits.get(3))
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            value = before if s == 16 else 0
            run = (3 + bits.get(2)) if s == 16 else (3 + bits.get(3)) if s == 17 else (11 + bits.get(7))
            if at + run > alphabet:
                raise BadImage("too many code lengths")
            lengths[at : at + run] = value
            at += run
    return PrefixCode(lengths)


def _extended(code: int, bits: BitReader) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.get(extra) + 1


class Stream:
    """One entropy-coded image: codes read at once, pixels on demand."""

    def __init__(self, bits: BitReader, width: int, height: int, main: bool) -> None:
        self.bits, self.width, self.height = bits, width, height
        self.cache_bits = bits.get(4) if bits.get(1) else 0
        if self.cache_bits > 11:
            raise BadImage("colour cache too large")
        self.meta, self.meta_bits, groups = None, 0, 1
        if main and bits.get(1):
            self.meta_bits = bits.get(3) + 2
            self.meta_width = -(-width >> self.meta_bits)
            tiles = Stream(bits, self.meta_width, -(-height >> self.meta_bits), False).pixels()
            self.meta = [p >> 8 & 0xFFFF for p in tiles]
            groups = max(self.meta) + 1
        green = 280 + (1 << self.cache_bits if self.cache_bits else 0)
        self.groups = [[read_code(bits, n) for n in (green, 256, 256, 256, 40)] for _ in range(groups)]

    def plain_gray(self) -> bool:
        """Whether green alone is coded, by short codes of literals."""
        codes = self.groups[0]
        return (
            self.meta is None
            and not self.cache_bits
            and all(c.only is not None for c in codes[1:4])
            and codes[0].only is None
            and codes[0].bits <= FAST_BITS
            and not codes[0].lengths[256:].any()
        )

    def pixels(self) -> list[int]:
        """ARGB of all pixels."""
        bits, width = self.bits, self.width
        n = width * self.height
        out: list[int] = []
        cache = [0] * (1 << self.cache_bits) if self.cache_bits else None
        shift = 32 - self.cache_bits
        done = 0  # pixels that are in the cache
        codes = self.groups[0]
        while len(out) < n:
            if self.meta is not None:
                y, x = divmod(len(out), width)
                codes = self.groups[self.meta[(y >> self.meta_bits) * self.meta_width + (x >> self.meta_bits)]]
            s = codes[0].read(bits)
            if s < 256:
                red, blue = codes[1].read(bits), codes[2].read(bits)
                out.append(codes[3].read(bits) << 24 | red << 16 | s << 8 | blue)
            elif s < 280:
                length = _extended(s - 256, bits)
                code = _extended(codes[4].read(bits), bits)
                if code > 120:
                    distance = code - 120
                else:
                    x, y = NEAR[code - 1]
                    distance = max(1, x + y * width)
                if distance > len(out) or len(out) + length > n:
                    raise BadImage("reference outside the image")
                for _ in range(length):
                    out.append(out[-distance])
            else:
                for p in out[done:]:
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
                done = len(out)
                out.append(cache[s - 280])
        return out


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) // 2


def _predict(mode: int, left, top, top_right, top_left):
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        guess = left + top - top_left
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + np.fix((mean - top_left) / 2).astype(np.int64), 0, 255)
    return np.array([255, 0, 0, 0])


def undo_predictor(rest: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels (h, w, 4 as ARGB) from what is left of them after the prediction of each tile's mode."""
    h, w, _ = rest.shape
    out = np.zeros((h, w, 4), np.int64)
    black = np.array([255, 0, 0, 0])
    for y in range(h):
        for x in range(w):
            if not x or not y:
                guess = black if not x and not y else out[y, x - 1] if not y else out[y - 1, x]
            else:
                right = out[y - 1, x + 1] if x + 1 < w else out[y, 0]
                guess = _predict(int(modes[y >> bits, x >> bits]), out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])
            out[y, x] = (rest[y, x] + guess) & 255
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def undo_cross_colour(pixels: np.ndarray, tiles: np.ndarray, bits: int) -> np.ndarray:
    """Add to red and blue what each tile's factors take from green, and to blue from the new red."""
    h, w, _ = pixels.shape
    t = _signed(tiles[np.arange(h)[:, None] >> bits, np.arange(w) >> bits])
    out = pixels.copy()
    green = _signed(pixels[..., 2])
    out[..., 1] = pixels[..., 1] + (t[..., 3] * green >> 5) & 255
    out[..., 3] = pixels[..., 3] + (t[..., 2] * green >> 5) + (t[..., 1] * _signed(out[..., 1]) >> 5) & 255
    return out


def _channels(pixels: list[int], width: int) -> np.ndarray:
    p = np.array(pixels, np.int64)
    return np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], -1).reshape(-1, width, 4)


class Image:
    """A parsed header: size, transforms, and the stream of the main pixels."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise BadImage("no lossless WebP container")
        (size,) = struct.unpack("<I", data[16:20])
        if 20 + size > len(data):
            raise BadImage("the data end early")
        bits = BitReader(data[20 : 20 + size])
        if bits.get(8) != 0x2F:
            raise BadImage("wrong signature")
        self.width, self.height = bits.get(14) + 1, bits.get(14) + 1
        bits.get(1)
        if bits.get(3):
            raise BadImage("unknown version")
        self.undo: list[tuple] = []
        width = self.width
        while bits.get(1):
            kind = bits.get(2)
            if kind in {x[0] for x in self.undo}:
                raise BadImage("a transform twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                tile = bits.get(3) + 2
                across = -(-width >> tile)
                tiles = _channels(Stream(bits, across, -(-self.height >> tile), False).pixels(), across)
                self.undo.append((kind, tile, tiles))
            elif kind == PALETTE:
                n = bits.get(8) + 1
                colours = np.cumsum(_channels(Stream(bits, n, 1, False).pixels(), n)[0], axis=0) & 255
                packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.undo.append((kind, packed, colours, width))
                width = -(-width >> packed)
            else:
                self.undo.append((kind,))
        self.stream = Stream(bits, width, self.height, True)

    def fast(self) -> bool:
        return [x[0] for x in self.undo] == [SUBTRACT_GREEN] and self.stream.plain_gray()

    def argb(self) -> np.ndarray:
        """(height, width, 4) of all pixels, the transforms undone."""
        out = _channels(self.stream.pixels(), self.stream.width)
        for kind, *how in reversed(self.undo):
            if kind == PREDICTOR:
                out = undo_predictor(out, how[1][..., 2] & 15, how[0])
            elif kind == CROSS_COLOUR:
                out = undo_cross_colour(out, how[1], how[0])
            elif kind == SUBTRACT_GREEN:
                out[..., 1] = out[..., 1] + out[..., 2] & 255
                out[..., 3] = out[..., 3] + out[..., 2] & 255
            else:
                packed, colours, width = how
                index = out[..., 2]
                if packed:
                    depth = 8 >> packed
                    parts = [index >> depth * k & (1 << depth) - 1 for k in range(1 << packed)]
                    index = np.stack(parts, -1).reshape(len(index), -1)[:, :width]
                table = np.zeros((256, 4), np.int64)
                table[: len(colours)] = colours
                out = table[index]
        return out


#: Images read side by side; below so many left, each is read alone. Steps between looks at what is done.
LANES, ALONE, STRIDE = 1024, 24, 256


def read_lanes(images: list[Image]) -> list[bytes]:
    """Green samples of images that are fast(), one symbol of each at a time."""
    n = [i.width * i.height for i in images]
    order = sorted(range(len(images)), key=lambda k: -n[k])
    out: list[list[bytes]] = [[] for _ in images]
    tables = np.concatenate([lookup_table(images[k].stream.groups[0][0].lengths, FAST_BITS) for k in order]).astype(np.uint16)
    starts, blobs, at = [], [], 0
    for k in order:
        bits = images[k].stream.bits
        starts.append(8 * at + bits.at)
        blobs.append(bits.data)
        at += len(bits.data)
    raw = np.frombuffer(b"".join(blobs) + b"\0" * 8, np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
    pos = np.array(starts, np.int64)
    base = np.arange(len(order), dtype=np.int64) << FAST_BITS
    left = np.array([n[k] for k in order])
    mask = np.uint32((1 << FAST_BITS) - 1)
    last = len(words) - 1
    live = len(order)
    while live > ALONE:
        steps = min(STRIDE, int(left[0]) + 1 & ~1)
        pos, base, left = pos[:live], base[:live], left[:live]
        block = np.empty((steps, live), np.uint8)
        for t in range(0, steps, 2):
            x = words.take(np.minimum(pos >> 3, last)) >> (pos & 7).astype(np.uint32)
            one = tables.take((x & mask) + base)
            size = one & 15
            two = tables.take((x >> size & mask) + base)
            block[t] = one >> 4
            block[t + 1] = two >> 4
            pos = pos + (size + (two & 15))
        rows = np.ascontiguousarray(block.T)
        for i in range(live):
            out[order[i]].append(rows[i, : min(steps, int(left[i]))].tobytes())
        left = left - steps
        live = int((left > 0).sum())
    for i in range(live):
        data, where = images[order[i]].stream.bits.data, int(pos[i]) - starts[i] + images[order[i]].stream.bits.at
        table = tables[int(base[i]) : int(base[i]) + (1 << FAST_BITS)].tolist()
        part = bytearray()
        for _ in range(int(left[i])):
            e = table[int.from_bytes(data[where >> 3 : (where >> 3) + 3], "little") >> (where & 7) & 4095]
            part.append(e >> 4)
            where += e & 15
        out[order[i]].append(bytes(part))
    return [b"".join(x) for x in out]


def read_images(media: list[bytes | None]) -> list[tuple | None]:
    """(width, height, channels, samples) of each image, None for null or bad ones. Gray, opaque images have one
    channel, others four: red, green, blue, alpha."""
    found: list[tuple | None] = [None] * len(media)
    fast: list[tuple[int, Image]] = []
    for k, data in enumerate(media):
        if data is None:
            continue
        try:
            image = Image(data)
            if image.fast() and [c.only for c in image.stream.groups[0][1:4]] == [0, 0, 255]:
                fast.append((k, image))
                continue
            argb = image.argb().astype(np.uint8)
        except BadImage:
            continue
        alpha, red, green, blue = (argb[..., i] for i in range(4))
        if (alpha == 255).all() and (red == green).all() and (blue == green).all():
            found[k] = (image.width, image.height, 1, green.tobytes())
        else:
            found[k] = (image.width, image.height, 4, argb[..., [1, 2, 3, 0]].tobytes())
    fast.sort(key=lambda x: x[1].width * x[1].height)
    for at in range(0, len(fast), LANES):
        part = fast[at : at + LANES]
        for (k, image), samples in zip(part, read_lanes([i for _, i in part]), strict=True):
            found[k] = (image.width, image.height, 1, samples)
    return found


# ---- columns


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_bytes and media: each whole text (null: empty) as UTF-8, filled up with zeros to a positive multiple
    of 64, as write_payload() stores it: one gray lossless WebP image, of longer texts several in a row."""

    def start():
        def store(texts: list) -> dict:
            raw = [(t or "").encode() for t in texts]
            return {"n_bytes": [len(r) for r in raw], "media": [write_payload(padded(r)) for r in raw]}

        return store

    return common.add_by_text(docs, start, text, "n_bytes bigint, media binary")


def read_texts(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the payload that store_texts() stored; null of null or damaged media."""

    def start():
        return lambda blobs: {"payload": read_payloads(blobs)}

    return common.add_by_text(df, start, media, "payload binary")


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with width, height, channels and samples of each image: its pixel array, row by row. Null and damaged
    images give nulls."""

    def start():
        def read(blobs: list) -> dict:
            got = [x or (None,) * 4 for x in read_images(blobs)]
            return dict(zip(("width", "height", "channels", "samples"), map(list, zip(*got, strict=True)), strict=True))

        return read

    return common.add_by_text(df, start, media, "width int, height int, channels int, samples binary")


def describe(samples: bytes) -> str:
    """Mean, entropy in bits, and mean step between neighbours, of 8-bit samples."""
    raw = np.frombuffer(samples, np.uint8)
    share = np.bincount(raw, minlength=256) / max(1, len(raw))
    some = share[share > 0]
    step = np.abs(np.diff(raw.astype(np.int16))).mean() if len(raw) > 1 else 0.0
    return f"mean={share @ np.arange(256):.4f};bits={-(some * np.log2(some)).sum() + 0.0:.4f};step={step:.4f}"


def digest_round_trip(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the digests of what store_texts() stores and read_texts() gets back, in one pass: media stay in the
    task that makes them, some eight megabytes of text at a time."""

    def start():
        def digest(texts: list) -> dict:
            raw = [(t or "").encode() for t in texts]
            media = [write_payload(padded(r)) for r in raw]
            back = read_payloads(media)
            return {
                "n_bytes": [len(r) for r in raw],
                "payload_bytes": [len(b) for b in back],
                "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                "tail_crc32": [zlib.crc32(b[-64:]) for b in back],
                "media_bytes": [len(m) for m in media],
                "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                "feature": [describe(b) for b in back],
            }

        return digest

    new = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint"
    return common.add_by_text(docs, start, text, new + ", media_sha256 string, feature string").drop(text)


def op2_media_webp_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the digests of their stored form and of what is read back; see digest_round_trip()."""
    return digest_round_trip(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
