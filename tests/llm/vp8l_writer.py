"""A plain writer of lossless WebP with every feature, to test the reader. Pixels are lists of (a, r, g, b)."""

import numpy as np
from cuemill.llm.webp_lossless import NEAR, BitWriter, canonical_codes, code_lengths, container, put_lengths, put_symbol


def predict(mode, left, top, right, corner):
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    return {
        0: lambda: [255, 0, 0, 0], 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: avg(avg(left, right), top), 6: lambda: avg(left, corner), 7: lambda: avg(left, top),
        8: lambda: avg(corner, top), 9: lambda: avg(top, right), 10: lambda: avg(avg(left, corner), avg(top, right)),
        12: lambda: [clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True)],
        13: lambda: [clamp(m + int((m - c) / 2)) for m, c in zip(avg(left, top), corner, strict=True)],
    }[mode]()


def subtract_prediction(pixels, w, h, bits, modes):
    across, out = -(-w >> bits), []
    for y in range(h):
        for x in range(w):
            at = lambda i, j: pixels[j * w + i]
            if x == y == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = at(x - 1, 0)
            elif x == 0:
                p = at(0, y - 1)
            else:
                right = at(x + 1, y - 1) if x + 1 < w else at(0, y)
                p = predict(modes[(y >> bits) * across + (x >> bits)], at(x - 1, y), at(x, y - 1), right, at(x - 1, y - 1))
            out.append([(v - q) & 255 for v, q in zip(at(x, y), p, strict=True)])
    return out


def signed(v):
    return v - 256 if v > 127 else v


def cross_colour(pixels, w, bits, factors):
    across, out = -(-w >> bits), []
    for k, (a, r, g, b) in enumerate(pixels):
        y, x = divmod(k, w)
        to_red, green_blue, red_blue = factors[(y >> bits) * across + (x >> bits)]
        delta = lambda t, c: signed(t) * signed(c) >> 5
        out.append([a, (r - delta(to_red, g)) & 255, g, (b - delta(green_blue, g) - delta(red_blue, r)) & 255])
    return out


def put_code(out, symbols, alphabet):
    counts = np.bincount(symbols, minlength=alphabet) if len(symbols) else np.zeros(alphabet, int)
    used = np.nonzero(counts)[0]
    if len(used) == 0:
        put_symbol(out, 0)
        return np.zeros(alphabet, int), np.zeros(alphabet, int)
    if len(used) == 1 and used[0] < 256:
        put_symbol(out, int(used[0]))
        return np.zeros(alphabet, int), np.zeros(alphabet, int)
    if len(used) == 1:
        counts[0] += 1
        used = np.nonzero(counts)[0]
    lengths = code_lengths(counts, 15)
    if len(used) == 2 and used[1] < 256:
        for v, n in ((1, 1), (1, 1), (1, 1), (int(used[0]), 8), (int(used[1]), 8)):
            out.put(v, n)
    else:
        put_lengths(out, lengths.tolist())
    return lengths, canonical_codes(lengths)


def split(value):
    """Prefix symbol, extra bits and their value of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, n - 1, v & ((1 << (n - 1)) - 1)


def put_stream(out, pixels, width, main=False, cache_bits=0, copies=False, groups=None):
    """groups: (bits, group of each tile)."""
    argb = [a << 24 | r << 16 | g << 8 | b for a, r, g, b in pixels]
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    tiles = None
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            bits, tiles = groups
            across = -(-width >> bits)
            out.put(bits - 2, 3)
            put_stream(out, [[0, t >> 8, t & 255, 0] for t in tiles], across)
    n_groups = max(tiles) + 1 if tiles else 1
    cache, items, k = {}, [], 0
    near = {x + y * width: i + 1 for i, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while k < len(argb):
        y, x = divmod(k, width)
        g = tiles[(y >> bits) * across + (x >> bits)] if tiles else 0
        run, best = 0, 0
        if copies:
            for d in (1, 2, 3, width, width + 1, 7, 3 * width):
                n = 0
                while d <= k and k + n < len(argb) and n < 4000 and argb[k + n] == argb[k + n - d]:
                    n += 1
                if n > run:
                    run, best = n, d
        if run >= 3:
            items.append((g, "copy", run, near.get(best, best + 120)))
        elif cache_bits and cache.get(slot(argb[k])) == argb[k]:
            items.append((g, "cache", slot(argb[k]), 0))
            run = 1
        else:
            items.append((g, "pixel", argb[k], 0))
            run = 1
        if cache_bits:
            for p in argb[k : k + run]:
                cache[slot(p)] = p
        k += run
    codes = []
    for g in range(n_groups):
        own = [i for i in items if i[0] == g]
        pix = [v for _, kind, v, _ in own if kind == "pixel"]
        green = [p >> 8 & 255 for p in pix] + [256 + split(n)[0] for _, kind, n, _ in own if kind == "copy"]
        green += [280 + v for _, kind, v, _ in own if kind == "cache"]
        dist = [split(d)[0] for _, kind, _, d in own if kind == "copy"]
        size = 280 + (1 << cache_bits if cache_bits else 0)
        codes.append([put_code(out, s, n) for s, n in ((green, size), ([p >> 16 & 255 for p in pix], 256), ([p & 255 for p in pix], 256), ([p >> 24 for p in pix], 256), (dist, 40))])
    for g, kind, v, d in items:
        put = lambda i, s, own=codes[g]: out.put(int(own[i][1][s]), int(own[i][0][s]))
        if kind == "pixel":
            put(0, v >> 8 & 255), put(1, v >> 16 & 255), put(2, v & 255), put(3, v >> 24)
        elif kind == "cache":
            put(0, 280 + v)
        else:
            s, n, e = split(v)
            put(0, 256 + s), out.put(e, n)
            s, n, e = split(d)
            put(4, s), out.put(e, n)


def write(pixels, width, transforms=(), **how):
    """transforms: ("predictor", bits, modes), ("cross", bits, factors), ("green",), ("palette",), in the order applied."""
    height = len(pixels) // width
    out = BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    w = width
    for t in transforms:
        out.put(1, 1)
        if t[0] == "predictor":
            out.put(0, 2), out.put(t[1] - 2, 3)
            put_stream(out, [[255, 0, m, 0] for m in t[2]], -(-w >> t[1]))
            pixels = subtract_prediction(pixels, w, height, t[1], t[2])
        elif t[0] == "cross":
            out.put(1, 2), out.put(t[1] - 2, 3)
            put_stream(out, [[255, rb, gb, gr] for gr, gb, rb in t[2]], -(-w >> t[1]))
            pixels = cross_colour(pixels, w, t[1], t[2])
        elif t[0] == "green":
            out.put(2, 2)
            pixels = [[a, (r - g) & 255, g, (b - g) & 255] for a, r, g, b in pixels]
        else:
            table = sorted({tuple(p) for p in pixels})
            out.put(3, 2), out.put(len(table) - 1, 8)
            steps = [[(v - q) & 255 for v, q in zip(p, before, strict=True)] for p, before in zip(table, [(0, 0, 0, 0), *table], strict=False)]
            put_stream(out, steps, len(table))
            packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            place, depth, rows = {p: i for i, p in enumerate(table)}, 8 >> packed, []
            for y in range(height):
                row = [place[tuple(p)] for p in pixels[y * w : (y + 1) * w]]
                for x in range(0, w, 1 << packed):
                    rows.append([255, 0, sum(v << depth * i for i, v in enumerate(row[x : x + (1 << packed)])), 0])
            pixels, w = rows, -(-w >> packed)
    out.put(0, 1)
    put_stream(out, pixels, w, True, **how)
    return container(out.value.to_bytes((out.count + 7) // 8, "little"))
