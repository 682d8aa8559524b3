"""Lossless WebP (VP8L in a RIFF container): a whole decoder and two encoders.

The decoder reads prefix codes, back-references, the colour cache, meta prefix codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Grey images (green is the only coded channel, one group of codes,
no cache) are decoded with array operations, their back-references included; everything else pixel by pixel. Many grey
images without transforms are written, and read, with array operations over all of them.
encode_grey chooses back-references, a palette with bundled pixels, and a predictor where they make the file shorter; a
colour cache can't, since a literal of a grey image costs no more than a cache code. encode takes any ARGB image and has
every feature. Images are arrays of height x width unsigned 32-bit ARGB.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_SIDE = 1 << 14
MAX_REFERENCE, MAX_DISTANCE = 4096, (1 << 20) - 120
MAX_CODE_LENGTH = 15
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE_BLACK = 0xFF000000

#: Starts, lengths and distances of back-references.
References = tuple[np.ndarray, np.ndarray, np.ndarray]

#: Bytes of a stream that are looked up at once, and of samples that are searched for references at once.
STRETCH, BLOCK = 1 << 17, 1 << 21
#: Least pixels of a back-reference that the grey encoder looks for; bits that a reference, and a further code, are taken
#: to cost.
LEAST_REFERENCE, REFERENCE_BITS, CODE_BITS = 8, 24, 100
#: Entropy of a sample in bits from which a predictor is tried; prose has less, and its differences more.
ROUGH_BITS = 5.5

#: Least streams to decode side by side, codes that each goes on between looks for streams that have ended, and bits that
#: a look-up takes at once (a byte's).
LEAST_LANES, LANE_STEPS, LANE_BITS = 24, 64, 8

#: The 120 short distances, nearest first, as (columns to the left, rows up).
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0
        self.end = 8 * len(data)

    def peek(self, n: int = 24) -> int:
        """At least so many bits from the current position."""
        p = self.at >> 3
        return int.from_bytes(self.data[p : p + (n >> 3) + 2], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek(n) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too soon")
        return value


class BitWriter:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, bytearray()

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 4096:
            whole = self.n >> 3
            self.done += (self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.value >>= 8 * whole
            self.n &= 7

    def __len__(self) -> int:
        return 8 * len(self.done) + self.n

    def bits(self) -> np.ndarray:
        """All bits written so far, first bit first."""
        return np.unpackbits(np.frombuffer(self.bytes(), np.uint8), bitorder="little")[: len(self)]

    def bytes(self) -> bytes:
        return bytes(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


# Prefix codes


@functools.cache
def _backwards(bits: int) -> np.ndarray:
    """The numbers of so many bits with their bits in reverse."""
    n = np.arange(1 << bits)
    return sum((((n >> k) & 1) << (bits - 1 - k) for k in range(bits)), np.zeros_like(n))


def code_arrays(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols that have a code, in order of their codes, with the codes (first bit lowest) and their lengths."""
    n = np.asarray(lengths, np.int64)
    used = np.flatnonzero(n)
    used = used[np.argsort(n[used], kind="stable")]
    n = n[used]
    share = 1 << (MAX_CODE_LENGTH - n)
    return used, _backwards(MAX_CODE_LENGTH)[(np.cumsum(share) - share) & ((1 << MAX_CODE_LENGTH) - 1)], n


@functools.cache
def _backwards_list() -> list[int]:
    return _backwards(MAX_CODE_LENGTH).tolist()


def canonical_codes(lengths: list[int]) -> dict[int, int]:
    """Symbol -> code, with its first bit lowest."""
    codes, reverse, at = {}, _backwards_list(), 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        codes[s] = reverse[at]
        at += 1 << (MAX_CODE_LENGTH - n)
    return codes


class PrefixCode:
    """A table for windows as wide as the longest code, or one symbol that takes no bits."""

    def __init__(self, lengths: list[int], single: int | None = None):
        self.symbols = self.lengths = None
        self.single = self.highest = single
        if single is not None:
            return
        used, _, n = code_arrays(lengths)
        if len(used) == 1:
            self.single = self.highest = int(used[0])
            return
        if not len(used) or (1 << (MAX_CODE_LENGTH - n)).sum() != 1 << MAX_CODE_LENGTH:
            raise ValueError("not a complete prefix code")
        most = int(n[-1])
        self.mask, self.highest = (1 << most) - 1, int(used.max())
        times, order = 1 << (most - n), _backwards(most)  # windows whose bits are in reverse stand in order of the codes
        self.symbols = np.repeat(used, times)[order].astype(np.uint16)
        self.lengths = np.repeat(n, times)[order].astype(np.uint8)

    def read(self, bits: BitReader) -> int:
        if self.single is not None:
            return self.single
        window = bits.peek() & self.mask
        bits.read(int(self.lengths[window]))
        return int(self.symbols[window])


def read_prefix_code(bits: BitReader, alphabet: int) -> PrefixCode:
    return PrefixCode(*read_lengths(bits, alphabet))


def read_lengths(bits: BitReader, alphabet: int) -> tuple[list[int], int | None]:
    """The code length of each symbol, or the one symbol that takes no bits."""
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two:
            return lengths, first
        second = bits.read(8)
        if first == second or max(first, second) >= alphabet:
            raise ValueError("bad simple code")
        lengths[first] = lengths[second] = 1
        return lengths, None
    code_lengths = [0] * len(CODE_LENGTH_ORDER)
    shown = 4 + bits.read(4)
    packed = bits.read(3 * shown)
    for s in CODE_LENGTH_ORDER[:shown]:
        code_lengths[s] = packed & 7
        packed >>= 3
    codes = canonical_codes(code_lengths)
    only = next(iter(codes)) if len(codes) == 1 else None
    most, whole = max(code_lengths), sum(1 << (7 - n) for n in code_lengths if n)
    if only is None and whole != 1 << 7:
        raise ValueError("not a complete prefix code")
    mask, table = (1 << most) - 1, [(0, 0)] * (1 << most)
    for s, c in codes.items():
        table[c :: 1 << code_lengths[s]] = [(s, code_lengths[s])] * (1 << (most - code_lengths[s]))
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    # the lengths are at most 14 bits each: they are taken off one number that holds them all
    first = bits.at
    window = int.from_bytes(bits.data[first >> 3 : (first >> 3) + 2 * alphabet + 8], "little") >> (first & 7)
    at, before, taken = 0, 8, 0
    while at < alphabet and left:
        left -= 1
        if only is None:
            s, n = table[window & mask]
            window >>= n
            taken += n
        else:
            s = only
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        extra = (2, 3, 7)[s - 16]
        times = (11 if s == 18 else 3) + (window & ((1 << extra) - 1))
        window >>= extra
        taken += extra
        if at + times > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + times] = [before if s == 16 else 0] * times
        at += times
    bits.at = first + taken
    if bits.at > bits.end:
        raise ValueError("the stream ends too soon")
    return lengths, None


def limited_lengths(counts: list[int], most: int = MAX_CODE_LENGTH) -> list[int]:
    """Huffman code lengths of at most so many bits; counts are flattened until they fit."""
    used = [(n, s) for s, n in enumerate(counts) if n]
    lengths = [0] * len(counts)
    if len(used) <= 1:
        for _, s in used:
            lengths[s] = 1
        return lengths
    least, last = 1, 2 * len(used) - 1
    while True:
        # leaves by number, then the nodes in the order they are made: both are sorted, so the least stand in front
        leaves = sorted([(max(n, least), k) for k, (n, _) in enumerate(used)])
        leaves.append((1 << 62, 0))
        weights, parent = [1 << 62] * (last + 1), [0] * last
        leaf, node = 0, len(used)
        for new in range(len(used), last):
            if leaves[leaf][0] <= weights[node]:
                n1, a = leaves[leaf]
                leaf += 1
            else:
                n1, a = weights[node], node
                node += 1
            if leaves[leaf][0] <= weights[node]:
                n2, b = leaves[leaf]
                leaf += 1
            else:
                n2, b = weights[node], node
                node += 1
            weights[new] = n1 + n2
            parent[a] = parent[b] = new
        depth = [0] * len(parent)
        for k in range(len(parent) - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= most:
            for k, (_, s) in enumerate(used):
                lengths[s] = depth[k]
            return lengths
        least *= 2


def write_single_code(bits: BitWriter, symbol: int) -> None:
    """A code with one symbol, which takes no bits."""
    bits.write(0b101 if symbol > 1 else 0b001, 3)
    bits.write(symbol, 8 if symbol > 1 else 1)


def write_prefix_code(bits: BitWriter, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        write_single_code(bits, used[0] if used else 0)
        return
    if len(used) == 2 and used[1] < 256:
        bits.write(1, 1)
        bits.write(1, 1)
        bits.write(1, 1)
        bits.write(used[0], 8)
        bits.write(used[1], 8)
        return
    tokens, end = [], used[-1] + 1
    for n, same in itertools.groupby(lengths[:end]):
        run = len(list(same))
        if n:
            tokens.append((n, 0, 0))
            run -= 1
            while run >= 3:
                some = min(run, 6)
                tokens.append((16, some - 3, 2))
                run -= some
            tokens += [(n, 0, 0)] * run
        else:
            while run >= 3:
                some = min(run, 138)
                tokens.append((18, some - 11, 7) if some > 10 else (17, some - 3, 3))
                run -= some
            tokens += [(0, 0, 0)] * run
    counts = [0] * len(CODE_LENGTH_ORDER)
    for s, _, _ in tokens:
        counts[s] += 1
    code_lengths = limited_lengths(counts, 7)
    if sum(map(bool, code_lengths)) == 1:
        only = next(s for s, n in enumerate(code_lengths) if n)
        code_lengths[0 if only else 1] = 1  # a second code that is not used, so that the code is complete
    shown = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if code_lengths[s]) + 1
    bits.write(0, 1)
    bits.write(max(shown, 4) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(shown, 4)]:
        bits.write(code_lengths[s], 3)
    bits.write(1, 1)
    n = max(2, (len(tokens) - 2).bit_length())
    n += n & 1
    bits.write((n - 2) // 2, 3)
    bits.write(len(tokens) - 2, n)
    codes = canonical_codes(code_lengths)
    value = at = 0
    for s, extra, width in tokens:
        value |= (codes[s] | extra << code_lengths[s]) << at
        at += code_lengths[s] + width
    bits.write(value, at)


def prefixed(value: int) -> tuple[int, int, int]:
    """A length or distance as prefix symbol, extra bits and their number."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def read_prefixed(bits: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# Pixels


def _windows(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At least 24 bits from each bit position; raw: the bytes as 32-bit words of 4 from each byte on."""
    return raw[at >> 3] >> (at & 7).astype(np.uint32)


def _extra_bits(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < 4, 0, (symbols - 2) >> 1)


def _prefixed_values(symbols: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return np.where(symbols < 4, symbols + 1, ((2 + (symbols & 1)) << _extra_bits(symbols)) + extra + 1)


@functools.cache
def near_distances(width: int) -> np.ndarray:
    """The distance in pixels of each of the short distance codes, from 1 on."""
    return np.array([0, *[max(1, x + y * width) for x, y in NEAR]], np.int64)


def _followed(steps: np.ndarray, first: int, end: int) -> np.ndarray:
    """The positions from first on, each by its own step from the one before, up to the end."""
    last, here = len(steps) - 1, np.arange(len(steps), dtype=np.int32)
    two = steps + steps[np.minimum(here + steps, last)]
    four = two + two[np.minimum(here + two, last)]  # a step is at most 58 bits, so four fit into a byte
    places, p, jump = [], first, four.tobytes()
    put = places.append
    while p < end:
        put(p)
        p += jump[p]
    at = np.empty((len(places), 4), np.int64)
    at[:, 0] = places
    at[:, 2] = at[:, 0] + two[at[:, 0]]
    at[:, 1::2] = at[:, ::2] + steps[np.minimum(at[:, ::2], last)]
    at = at.ravel()
    return at[at < end]


def _grey_pixels(bits: BitReader, codes: list[PrefixCode], total: int, width: int) -> np.ndarray:
    """The green channel of the last image of a stream: the step to the next code is looked up at every bit position at
    once, the steps are followed, and references are resolved together."""
    green, distance = codes[0], codes[4]
    if green.single is not None:
        if green.single >= 256:
            raise ValueError("a reference leaves the image")
        return np.full(total, green.single, np.uint32)
    literal, place, length, back, done = [], [], [], [], 0
    while done < total:  # stretch by stretch, so that memory is bounded
        first = bits.at >> 3
        data = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - first, STRETCH + 16), first).astype(np.uint32)
        raw = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
        end = min(8 * (len(raw) - 12), bits.end - 8 * first)
        if end <= bits.at & 7:
            raise ValueError("the stream ends too soon")
        window = ((raw[: (end + 7) >> 3, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(green.mask)).ravel()[:end]
        symbols, steps = green.symbols[window], green.lengths[window].copy()
        refer = np.flatnonzero(symbols >= 256) if green.highest >= 256 else np.zeros(0, np.int64)
        if len(refer):
            n = _extra_bits(symbols[refer].astype(np.int64) - 256)
            at = refer + steps[refer] + n
            if distance.single is not None:
                far, used = np.full(len(at), distance.single), 0
            else:
                window = _windows(raw, at) & np.uint32(distance.mask)
                far, used = distance.symbols[window].astype(np.int64), distance.lengths[window]
            steps[refer] = steps[refer] + n + used + _extra_bits(far)
        at = _followed(steps, bits.at & 7, end)
        got = symbols[at].astype(np.int64)
        pixels = np.ones(len(at), np.int64)
        some = np.flatnonzero(got >= 256)
        if len(some):
            p, s = at[some], got[some] - 256
            p = p + green.lengths[_windows(raw, p) & np.uint32(green.mask)]
            n = _extra_bits(s)
            pixels[some] = _prefixed_values(s, _windows(raw, p) & ((1 << n) - 1).astype(np.uint32))
            p = p + n
            if distance.single is not None:
                far, used = np.full(len(p), distance.single), 0
            else:
                window = _windows(raw, p) & np.uint32(distance.mask)
                far, used = distance.symbols[window].astype(np.int64), distance.lengths[window]
            n = _extra_bits(far)
            d = _prefixed_values(far, _windows(raw, p + used) & ((1 << n) - 1).astype(np.uint32))
            back.append(np.where(d > len(NEAR), d - len(NEAR), near_distances(width)[np.minimum(d, len(NEAR))]))
        ends = done + np.cumsum(pixels)
        last = int(np.searchsorted(ends, total))
        if last < len(ends):  # what follows is no code any more
            at, got, pixels, ends = at[: last + 1], got[: last + 1], pixels[: last + 1], ends[: last + 1]
            if len(some):
                back[-1] = back[-1][: int(np.searchsorted(some, last, "right"))]
        elif 8 * first + end >= bits.end:
            raise ValueError("the stream ends too soon")
        literal.append(got)
        place.append(ends - pixels)
        length.append(pixels)
        done = int(ends[-1])
        bits.at = 8 * first + int(at[-1]) + int(steps[at[-1]])
    if done > total:
        raise ValueError("a reference leaves the image")
    if bits.at > bits.end:
        raise ValueError("the stream ends too soon")
    got, start, pixels = np.concatenate(literal), np.concatenate(place), np.concatenate(length)
    if not back:
        return got.astype(np.uint32)
    out, refer = np.zeros(total, np.uint32), got >= 256
    out[start[~refer]] = got[~refer]
    far, n, begin = np.concatenate(back), pixels[refer], start[refer]
    if (far > begin).any():
        raise ValueError("a reference leaves the image")
    copied = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    source = np.arange(total)
    source[copied] = copied - np.repeat(far, n)
    while True:  # every round doubles how many copies of copies are followed
        further = source[source[copied]]
        if np.array_equal(further, source[copied]):
            break
        source[copied] = further
    out[copied] = out[source[copied]]
    return out


def _read_pixels(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image as a flat array of ARGB."""
    total = width * height
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("bad colour cache")
    groups, tile, meta = 1, 0, None
    if main and bits.read(1):
        tile = 2 + bits.read(3)
        across = (width + (1 << tile) - 1) >> tile
        meta = (_read_pixels(bits, across, (height + (1 << tile) - 1) >> tile, False) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups = int(meta.max()) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    codes = [[read_prefix_code(bits, n) for n in (256 + LENGTH_CODES + cache_size, 256, 256, 256, DISTANCE_CODES)] for _ in range(groups)]
    if main and groups == 1 and not cache_bits and all(c.single is not None for c in codes[0][1:4]):
        green = _grey_pixels(bits, codes[0], total, width)
        return green << np.uint32(8) | np.uint32(codes[0][3].single << 24 | codes[0][1].single << 16 | codes[0][2].single)
    return _pixel_by_pixel(bits, codes, total, width, cache_bits, meta, tile, across if meta is not None else 0)


def _pixel_by_pixel(bits: BitReader, codes: list[list[PrefixCode]], total: int, width: int, cache_bits: int, meta: np.ndarray | None, tile: int, across: int) -> np.ndarray:
    out, cache, cached, at = [0] * total, [0] * (1 << cache_bits if cache_bits else 0), 0, 0
    group = codes[0]
    while at < total:
        if meta is not None:
            group = codes[int(meta[(at // width >> tile) * across + (at % width >> tile)])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + LENGTH_CODES:
            length = read_prefixed(bits, s - 256)
            distance = read_prefixed(bits, group[4].read(bits))
            if distance > len(NEAR):
                distance -= len(NEAR)
            else:
                x, y = NEAR[distance - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise ValueError("a reference leaves the image")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            while cached < at:
                c = out[cached]
                cache[(CACHE_FACTOR * c & 0xFFFFFFFF) >> (32 - cache_bits)] = c
                cached += 1
            out[at] = cache[s - 256 - LENGTH_CODES]
            at += 1
    return np.array(out, np.uint32)


# Transforms; channels are arrays of height x width x 4 in the order blue, green, red, alpha


def _channels(flat: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(flat.astype("<u4")).view(np.uint8).reshape(-1, width, 4)


def _flat(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4").ravel()


def _tiles(image: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """A transform's small image spread over the pixels."""
    return np.repeat(np.repeat(image, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def subtract_green(channels: np.ndarray, invert: bool) -> None:
    for c in (0, 2):
        channels[..., c] = channels[..., c] + channels[..., 1] if invert else channels[..., c] - channels[..., 1]


def cross_colour(channels: np.ndarray, tiles: np.ndarray, invert: bool) -> None:
    """tiles: height x width x 4 with green-to-red in blue, green-to-blue in green, red-to-blue in red."""
    signed = tiles.view(np.int8).astype(np.int32)
    delta = lambda t, c: (t * c.view(np.int8).astype(np.int32)) >> 5
    green, red = channels[..., 1].copy(), channels[..., 2].copy()
    sign = 1 if invert else -1
    new_red = (red.astype(np.int32) + sign * delta(signed[..., 0], green)).astype(np.uint8)
    true_red = new_red if invert else red
    blue = channels[..., 0].astype(np.int32) + sign * (delta(signed[..., 1], green) + delta(signed[..., 2], true_red))
    channels[..., 2], channels[..., 0] = new_red, blue.astype(np.uint8)


def _predicted(mode: int, left, top, top_left, top_right):
    mean = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    middle = mean(left, top)
    difference = middle - top_left
    return np.clip(middle + (np.abs(difference) // 2) * np.sign(difference), 0, 255)


def predictor(channels: np.ndarray, modes: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    """Add (or take away) the prediction of each pixel; modes: the mode of each tile."""
    height, width = channels.shape[:2]
    source = channels.astype(np.int64)
    if invert and (modes == modes.flat[0]).all() and modes.flat[0] in (1, 2):  # all from the left, or from above: sums
        source[0, 0, 3] += 255
        first = 0 if modes.flat[0] == 1 else 1
        edge = (slice(None), 0) if first == 0 else (0, slice(None))
        source[edge] = np.cumsum(source[edge], 0)
        return np.cumsum(source, 1 - first).astype(np.uint8)
    pixels = source.copy() if invert else source
    out = source.copy()
    for y in range(height):
        for x in range(width):
            if not x and not y:
                guess = np.array([0, 0, 0, 255])
            elif not y:
                guess = pixels[y, x - 1]
            elif not x:
                guess = pixels[y - 1, x]
            else:
                right = pixels[y - 1, x + 1] if x + 1 < width else pixels[y, 0]
                guess = _predicted(int(modes[y >> bits, x >> bits]), pixels[y, x - 1], pixels[y - 1, x], pixels[y - 1, x - 1], right)
            if invert:
                pixels[y, x] = (source[y, x] + guess) & 255
            else:
                out[y, x] = (source[y, x] - guess) & 255
    return (pixels if invert else out).astype(np.uint8)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# Whole files


def _opened(data: bytes) -> tuple[BitReader, int, int]:
    """The stream of a file that holds one VP8L chunk, behind its header, and the image's width and height."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP")
    size = int.from_bytes(data[16:20], "little")
    bits = BitReader(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("bad version")
    return bits, width, height


def decode(data: bytes) -> np.ndarray:
    """The image in a file that holds one VP8L chunk."""
    bits, width, height = _opened(data)
    todo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = 2 + bits.read(3)
            across = (now + (1 << tile) - 1) >> tile
            todo.append((kind, now, tile, _channels(_read_pixels(bits, across, (height + (1 << tile) - 1) >> tile, False), across)))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind, now, 0, None))
        else:
            colours = bits.read(8) + 1
            table = np.cumsum(_channels(_read_pixels(bits, colours, 1, False), colours)[0], 0, dtype=np.uint8)
            todo.append((kind, now, _bundle_bits(colours), _flat(table)))
            now = (now + (1 << todo[-1][2]) - 1) >> todo[-1][2]
    flat = _read_pixels(bits, now, height, True)
    for kind, wide, tile, image in reversed(todo):
        if kind == PALETTE:
            index = ((flat >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            if tile:
                each = 8 >> tile
                index = np.stack([(index >> np.uint32(each * k)) & np.uint32((1 << each) - 1) for k in range(1 << tile)], -1).reshape(height, -1)[:, :wide]
            flat = np.where(index < len(image), image[np.minimum(index, len(image) - 1)], 0).astype(np.uint32).ravel()
            continue
        channels = _channels(flat, wide)
        if kind == SUBTRACT_GREEN:
            subtract_green(channels, True)
        elif kind == CROSS_COLOUR:
            cross_colour(channels, np.ascontiguousarray(_tiles(image, tile, wide, height)), True)
        else:
            channels = predictor(channels, image[..., 1], tile, True)
        flat = _flat(channels)
    return flat.reshape(height, width)


def decode_greens(files: list[bytes]) -> list[np.ndarray]:
    """The green channel of each file's image, as decode() gives it. Streams of grey images without transforms are decoded
    side by side, but for the few that are much longer than others."""
    lanes, out = [], [None] * len(files)
    for k, data in enumerate(files):
        bits, width, height = _opened(data)
        if bits.read(1) or bits.read(1) or bits.read(1):  # a transform, a colour cache, meta codes
            continue
        green, red, blue, alpha, far = (read_lengths(bits, n) for n in (256 + LENGTH_CODES, 256, 256, 256, DISTANCE_CODES))
        if sum(map(bool, green[0])) > 1 and red[1] is not None and blue[1] is not None and alpha[1] is not None and (far[1] or 0) < DISTANCE_CODES:
            lanes.append((bits.end - bits.at, k, bits, width, height, green[0], far))
    lanes.sort(key=lambda lane: (-lane[0], lane[1]))
    if len(lanes) >= LEAST_LANES:
        most = 2 * lanes[LEAST_LANES - 1][0]
        lanes = [lane for lane in lanes if lane[0] <= most]
        for (_, k, *_), green in zip(lanes, _side_by_side([lane[2:] for lane in lanes]), strict=True):
            out[k] = green
    return [(decode(data) >> np.uint32(8)).astype(np.uint8) if green is None else green for data, green in zip(files, out, strict=True)]


def _lane_tables(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of LANE_BITS bits for the codes of a green channel and of the distances, in turn, lane by lane, with the place
    of each first table. An entry holds, from the lowest bit: 6 bits for how far it goes, 5 for how many of these are
    extra bits, 2 for its kind (0 literal, 1 length, 2 distance, 3 a longer code), 9 for its symbol, and from bit 32 on
    the place of the table that comes next."""
    size, longest = 1 << LANE_BITS, 1 << MAX_CODE_LENGTH
    n = np.frombuffer(b"".join(bytes(c) for c in codes), np.uint8).astype(np.int64)
    of_code = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    symbol = np.concatenate([np.arange(len(c)) for c in codes])
    used = np.flatnonzero(n)
    used = used[np.argsort(of_code[used] * 16 + n[used], kind="stable")]
    n, of_code, symbol = n[used], of_code[used], symbol[used]
    share = longest >> n
    whole = np.bincount(of_code, share, len(codes))
    single = np.bincount(of_code, minlength=len(codes)) == 1
    if (whole[~single] != longest).any():
        raise ValueError("not a complete prefix code")
    share[single[of_code]] = longest
    n[single[of_code]] = 0  # the only symbol takes no bits
    code = _backwards(MAX_CODE_LENGTH)[(np.cumsum(share) - share) & (longest - 1)]
    long = n > LANE_BITS
    prefix = of_code[long] * size + (code[long] & (size - 1))
    fresh = np.diff(prefix, prepend=-1) != 0  # codes with one beginning stand together
    heads = prefix[fresh]
    tables = np.bincount(heads // size, minlength=len(codes)) + 1
    root = (np.cumsum(tables) - tables) * size
    below = (np.arange(len(heads)) - np.searchsorted(heads // size, heads // size) + 1) * size + root[heads // size]
    far = of_code & 1
    extra = np.where(far > 0, _extra_bits(symbol), np.where(symbol >= 256, _extra_bits(symbol - 256), 0))
    kind = np.where(far > 0, 2, (symbol >= 256).astype(np.int64))
    then = root[of_code - far + (kind == 1)]
    rest = np.where(long, n - LANE_BITS, n)
    entry = (rest + extra) | extra << 6 | kind << 11 | symbol << 13 | then << 32
    table = np.zeros(int(tables.sum()) * size, np.int64)
    base = root[of_code]
    base[long] = below[np.cumsum(fresh) - 1]
    times = size >> rest
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    table[np.repeat(base + np.where(long, code >> LANE_BITS, code), times) + (k << np.repeat(rest, times))] = np.repeat(entry, times)
    table[root[heads // size] + heads % size] = LANE_BITS | 3 << 11 | below << 32
    return table, root


def _lane_codes(data: np.ndarray, pos: np.ndarray, end: np.ndarray, table: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that the bits from pos to end of every lane lead to, lane by lane, and their number in each. What begins
    up to the end is read, be it filling bits: a distance that takes no bits may stand at the very end."""
    windows = ((data[:-1] | data[1:].astype(np.uint16) << 8)[:, None] >> np.arange(8, dtype=np.uint16)).astype(np.uint8).ravel()  # at each bit
    steps, then = table & 63, table >> 32
    lane, blocks, number = np.arange(len(pos)), [], np.zeros(len(pos), np.int64)
    pos, place = pos.copy(), root.copy()
    while len(lane):
        got, begin = np.empty((LANE_STEPS, len(lane)), np.int64), pos.copy()
        for entry in got:
            np.add(windows.take(pos, mode="clip"), place, out=entry)
            pos += steps.take(entry, mode="clip")
            then.take(entry, out=place, mode="clip")
        got = table[got.T]
        step = got & 63
        inside = begin[:, None] + np.cumsum(step, 1) - step <= end[:, None]
        some = inside.sum(1)
        blocks.append((lane, number[lane], some, got[inside]))
        number[lane] += some
        on = pos <= end
        lane, pos, place, end = lane[on], pos[on], place[on], end[on]
    out, first = np.empty(int(number.sum()), np.int64), np.cumsum(number) - number
    for lane, before, some, got in blocks:
        out[np.arange(len(got)) + np.repeat(first[lane] + before - (np.cumsum(some) - some), some)] = got
    return out, number


def _side_by_side(lanes: list[tuple]) -> list[np.ndarray]:
    """The green channels of grey images: one look-up takes a step in every stream. lanes: stream behind its codes, width,
    height, code lengths of the green channel, those of the distances or the only distance."""
    streams = [bits.data for bits, *_ in lanes]
    data = np.frombuffer(b"".join(streams) + bytes(4 * LANE_STEPS), np.uint8)
    first = 8 * (np.cumsum([len(x) for x in streams]) - [len(x) for x in streams])
    pos, end = first + [bits.at for bits, *_ in lanes], first + [bits.end for bits, *_ in lanes]
    codes = []
    for *_, green, (far, only) in lanes:
        codes += [green, far if only is None else [int(s == only) for s in range(DISTANCE_CODES)]]
    table, root = _lane_tables(codes)
    got, number = _lane_codes(data, pos, end, table, root[::2])
    lane, step = np.repeat(np.arange(len(lanes)), number), got & 63
    at = np.cumsum(step) - step
    at += np.repeat(pos - at[np.cumsum(number) - number], number)
    part = (got >> 11 & 3) == 3
    if part.any():
        got, at, lane = got[~part], at[~part], lane[~part]
    kind, extra, after = got >> 11 & 3, got >> 6 & 31, at + (got & 63)
    refer = np.flatnonzero(kind[:-1] == 1)
    refer = refer[(kind[refer + 1] == 2) & (lane[refer + 1] == lane[refer])]  # the filling bits may end in half a reference

    def values(k: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        p = after[k] - extra[k]
        word = sum(data[(p >> 3) + b].astype(np.int64) << 8 * b for b in range(4))
        return _prefixed_values(symbols, (word >> (p & 7)) & ((1 << extra[k]) - 1))

    pixels = (kind == 0).astype(np.int64)
    pixels[refer] = values(refer, (got[refer] >> 13 & 511) - 256)
    far = values(refer + 1, got[refer + 1] >> 13 & 511)
    widths, of_width = np.unique([width for _, width, *_ in lanes], return_inverse=True)
    near = np.stack([near_distances(int(width)) for width in widths])
    far = np.where(far > len(NEAR), far - len(NEAR), near[of_width[lane[refer]], np.minimum(far, len(NEAR))])
    after[refer] = after[refer + 1]
    sizes = np.array([width * height for _, width, height, *_ in lanes])
    number = np.bincount(lane, minlength=len(lanes))
    ends = np.append(0, np.cumsum(pixels))
    begin = ends[:-1] - np.repeat(ends[:-1][np.cumsum(number) - number], number)  # in the own image
    keep = (begin < sizes[lane]) & (pixels > 0)  # what follows is no code any more
    taken = np.bincount(lane[keep], pixels[keep], len(lanes))
    if (taken < sizes).any() or (after[keep] > end[lane[keep]]).any():
        raise ValueError("the stream ends too soon")
    inside = keep[refer]
    refer, far = refer[inside], far[inside]
    if (taken > sizes).any() or (far > begin[refer]).any():
        raise ValueError("a reference leaves the image")
    start = np.cumsum(sizes) - sizes
    place = begin + start[lane]
    out = bytearray(int(sizes.sum()))
    literal = np.flatnonzero(keep & (kind == 0))
    np.frombuffer(out, np.uint8)[place[literal]] = got[literal] >> 13 & 255
    for p, n, d in zip(place[refer].tolist(), pixels[refer].tolist(), far.tolist(), strict=True):
        out[p : p + n] = out[p - d : p - d + n] if d >= n else (out[p - d : p] * (n // d + 1))[:n]
    green = np.frombuffer(bytes(out), np.uint8)
    return [green[a : a + size].reshape(height, width) for a, size, (_, width, height, *_) in zip(start.tolist(), sizes.tolist(), lanes, strict=True)]


def _container(body: bytes) -> bytes:
    padded = body + bytes(len(body) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + padded


def _file(bits: np.ndarray) -> bytes:
    return _container(np.packbits(bits, bitorder="little").tobytes())


def _head(width: int, height: int, alpha: bool) -> BitWriter:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("bad size")
    bits = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        bits.write(value, n)
    return bits


def references(data: np.ndarray, doc: np.ndarray) -> References:
    """Back-references (start, length, distance) for arrays of bytes one after the other, doc telling which a byte is of.

    Every place is looked up in a sorted list of all strings of LEAST_REFERENCE bytes for the place before it that has
    the same string. Neighbours at one distance are one run; runs are taken from left to right as far as nothing covers
    them, with LEAST_REFERENCE pixels at least. Blocks of BLOCK bytes at most are searched each for themselves; they end
    where documents end, so that what a document gets does not depend on its neighbours. One longer than that is cut.
    """
    edges, cuts = np.append(np.flatnonzero(np.diff(doc)) + 1, len(data)), [0]
    while cuts[-1] < len(data):
        fits = int(edges[max(np.searchsorted(edges, cuts[-1] + BLOCK, "right") - 1, 0)])
        cuts.append(fits if cuts[-1] < fits <= cuts[-1] + BLOCK else cuts[-1] + BLOCK)
    blocks = [(a, _block_references(data[a:b], doc[a:b])) for a, b in zip(cuts, cuts[1:])] or [(0, _block_references(data, doc))]
    return tuple(np.concatenate([found[k] + (at if k == 0 else 0) for at, found in blocks]) for k in range(3))


def _block_references(data: np.ndarray, doc: np.ndarray) -> References:
    n = len(data) - LEAST_REFERENCE + 1
    if n < 2:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    key, whole = np.empty(n, np.uint64), data.tobytes()
    for k in range(min(LEAST_REFERENCE, n)):
        key[k::LEAST_REFERENCE] = np.frombuffer(whole, "<u8", (n - k + LEAST_REFERENCE - 1) // LEAST_REFERENCE, k)
    mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    order = (np.sort(mixed << np.uint64(32) | np.arange(n, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sorted_keys, own = key[order], doc[order]
    same = np.flatnonzero((sorted_keys[1:] == sorted_keys[:-1]) & (own[1:] == own[:-1]))
    far = np.zeros(n, np.int64)
    far[order[same + 1]] = order[same + 1] - order[same]
    far[(doc[:n] != doc[LEAST_REFERENCE - 1 :]) | (far > MAX_DISTANCE)] = 0
    change = np.flatnonzero(np.diff(far, prepend=-1))
    run = far[change]
    low, high = change[run > 0].tolist(), np.append(change[1:], n)[run > 0].tolist()
    starts, lengths, distances, covered = [], [], [], 0
    for a, b, d in zip(low, high, run[run > 0].tolist(), strict=True):
        if a < covered:
            a = covered
        if a < b:
            covered = b + LEAST_REFERENCE - 1
            starts.append(a)
            lengths.append(covered - a)
            distances.append(d)
    out = [np.array(x, np.int64) for x in (starts, lengths, distances)]
    while (out[1] > MAX_REFERENCE).any():
        long = out[1] > MAX_REFERENCE
        rest = out[1][long] - MAX_REFERENCE
        keep = rest >= 1
        more = [out[0][long][keep] + MAX_REFERENCE, rest[keep], out[2][long][keep]]
        out[1] = np.minimum(out[1], MAX_REFERENCE)
        out = [np.concatenate([x, y]) for x, y in zip(out, more, strict=True)]
    at = np.argsort(out[0], kind="stable")
    return out[0][at], out[1][at], out[2][at]


def _entropy_bits(counts: np.ndarray) -> np.ndarray:
    """Bits that an ideal code takes for the symbols of each row."""
    n = counts.astype(np.float64)
    total = n.sum(-1, keepdims=True)
    return (n * np.log2(np.divide(total, n, out=np.ones_like(n), where=n > 0))).sum(-1)


def _symbols_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as prefix symbols, extra bits and their numbers."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), np.where(v < 4, 0, v & ((1 << np.maximum(n, 0)) - 1)), n


def _write_greys(heads: list[BitWriter], flat: np.ndarray, sizes: np.ndarray, width: int, found: References, alpha: int) -> list[tuple[bytes, bool]]:
    """Files that go on after these heads with samples as the green channel, so many each of flat, with the references
    where they shorten a file; and whether they do. All arrays are those of all images, one after the other; what a file
    holds depends on its own samples only."""
    images, n_green = len(sizes), 256 + LENGTH_CODES
    image = np.repeat(np.arange(images), sizes)
    plain = np.bincount(image * 256 + flat, minlength=images * 256).reshape(images, 256)
    plain_bits = _entropy_bits(plain)
    of = image[found[0]]
    worth = found[1] * (plain_bits / sizes)[of] >= REFERENCE_BITS
    start, length, far, of = (x[worth] for x in (*found, of))
    near = np.zeros(int(near_distances(width).max()) + 2, np.int64)  # the last place is for all that are farther
    near[near_distances(width)[:0:-1]] = np.arange(len(NEAR), 0, -1)
    code = near[np.minimum(far, len(near) - 1)]
    code = np.where(code > 0, code, far + len(NEAR))
    s1, e1, n1 = _symbols_of(length)
    s2, e2, n2 = _symbols_of(code)

    def literals() -> np.ndarray:
        edge = np.zeros(len(flat) + 1, np.int8)
        edge[start] = 1
        edge[start + length] -= 1
        return np.cumsum(edge[:-1], dtype=np.int8) == 0

    literal = literals()
    counts = np.bincount(image[literal] * n_green + flat[literal], minlength=images * n_green) + np.bincount(of * n_green + 256 + s1, minlength=images * n_green)
    counts, distances = counts.reshape(images, n_green), np.bincount(of * DISTANCE_CODES + s2, minlength=images * DISTANCE_CODES).reshape(images, DISTANCE_CODES)
    extra = np.bincount(of, n1 + n2, images)
    use = (np.bincount(of, minlength=images) > 0) & (_entropy_bits(counts) + _entropy_bits(distances) + extra + CODE_BITS < plain_bits)
    if not use.all():
        counts[~use] = np.pad(plain[~use], ((0, 0), (0, LENGTH_CODES)))
        distances[~use] = 0
        start, length, of, s1, e1, n1, s2, e2, n2 = (x[use[of]] for x in (start, length, of, s1, e1, n1, s2, e2, n2))
        literal = literals()
    all_lengths, all_far_lengths = [], []
    for bits, green, far_counts in zip(heads, counts.tolist(), distances.tolist(), strict=True):
        bits.write(0, 2)  # no colour cache, no meta codes
        lengths = limited_lengths(green)
        if sum(map(bool, lengths)) == 1 and lengths.index(1) >= 256:
            lengths[0] = 1
        far_lengths = limited_lengths(far_counts)
        write_prefix_code(bits, lengths)
        for only in (0, 0, alpha):
            write_single_code(bits, only)
        write_prefix_code(bits, far_lengths)
        all_lengths.append(bytes(lengths))
        all_far_lengths.append(bytes(far_lengths))
    codes, widths = _code_tables(b"".join(all_lengths), images)
    far_codes, far_widths = _code_tables(b"".join(all_far_lengths), images)
    literal[start] = True
    at = np.flatnonzero(literal)
    image = image[at]
    symbol = image * n_green + flat[at]
    value, n = codes[symbol], widths[symbol]
    symbol, far_symbol, place = of * n_green + 256 + s1, of * DISTANCE_CODES + s2, np.searchsorted(at, start)
    v, k = codes[symbol], widths[symbol]
    for more, width_of in ((e1.astype(np.uint64), n1), (far_codes[far_symbol], far_widths[far_symbol]), (e2.astype(np.uint64), n2)):
        v = v | more << k.astype(np.uint64)
        k = k + width_of
    value[place], n[place] = v, k
    # every file starts at a byte; a token of at most 58 bits lies in one or two words of 64
    ends, last = np.cumsum(n), np.cumsum(np.bincount(image, minlength=images)) - 1
    so_far = np.append(0, ends[last])
    head = np.array([len(bits) for bits in heads])
    files = np.append(0, np.cumsum((head + np.diff(so_far) + 7) >> 3))
    first = ends - n + (8 * files[:-1] + head - so_far[:-1])[image]
    word, shift = first >> 6, (first & 63).astype(np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros((int(files[-1]) >> 3) + 2, np.uint64)
    words[word[new]] = np.bitwise_or.reduceat(value << shift, new)
    over = np.append(new[1:], len(word)) - 1
    words[word[over] + 1] |= (value[over] >> np.uint64(1)) >> (np.uint64(63) - shift[over])
    body, out = words.astype("<u8").tobytes(), []
    for bits, a, b, refers in zip(heads, files[:-1].tolist(), files[1:].tolist(), use.tolist(), strict=True):
        front, whole = bits.bytes(), len(bits) >> 3
        if len(bits) & 7 and a + whole < b:
            front = front[:whole] + bytes([front[whole] | body[a + whole]])
        out.append((_container(front + body[a + len(front) : b]), refers))
    return out


def _code_tables(lengths: bytes, images: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their sizes by image and symbol, in one row; a single symbol takes no bits."""
    n = np.frombuffer(lengths, np.uint8).reshape(images, -1)
    n = np.where((n > 0).sum(1, keepdims=True) > 1, n, 0).astype(np.int64).ravel()
    codes, used = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    used = used[np.argsort(used // (len(n) // images) * 16 + n[used], kind="stable")]
    share = 1 << (MAX_CODE_LENGTH - n[used])  # those of an image make up a whole, so one sum serves all
    codes[used] = _backwards(MAX_CODE_LENGTH)[(np.cumsum(share) - share) & ((1 << MAX_CODE_LENGTH) - 1)]
    return codes, n


def _differences(samples: np.ndarray, mode: int) -> np.ndarray:
    """Samples without what predictor mode 1 (left) or 2 (above) foretells."""
    out = samples.copy()
    if mode == 1:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
    else:
        out[1:] -= samples[:-1]
        out[0, 1:] -= samples[0, :-1]
    return out


def encode_grey(samples: np.ndarray, found: References | None = None) -> tuple[bytes, list[str]]:
    """height x width 8-bit samples as the green channel of opaque pixels, and which features the file uses.

    found: what references() gives for the samples. Of the plain samples, a palette of at most 16 values with bundled
    pixels, and the differences to the left or to above, the one with the least entropy is written.
    """
    height, width = samples.shape
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    colours = np.flatnonzero(counts)
    bits, used = _head(width, height, False), []
    if len(colours) <= 16 and len(flat) > 64:
        used.append("palette")
        bits.write(1, 1)
        bits.write(PALETTE, 2)
        bits.write(len(colours) - 1, 8)
        table = (colours.astype(np.uint32) << np.uint32(8)) | np.uint32(OPAQUE_BLACK)
        _write_pixels(bits, _flat(np.diff(_channels(table, len(table))[0], axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), 0, False, None, 0)
        pack = _bundle_bits(len(colours))
        each, wide = 8 >> pack, (width + (1 << pack) - 1) >> pack
        index = np.searchsorted(colours, samples).astype(np.uint8)
        index = np.pad(index, ((0, 0), (0, (wide << pack) - width))).reshape(height, wide, 1 << pack)
        flat, width, found = (index << (each * np.arange(1 << pack, dtype=np.uint8))).sum(-1).astype(np.uint8).ravel(), wide, None
    else:
        best = _entropy_bits(counts) - CODE_BITS
        for mode in (1, 2) if best > ROUGH_BITS * len(flat) else ():
            other = _differences(samples, mode)
            if (cost := _entropy_bits(np.bincount(other.ravel(), minlength=256))) < best:
                best, flat, found, used = cost, other.ravel(), None, ["predictor"]
                chosen = mode
        if used:
            tile = 9  # the widest tiles
            shape = (height + (1 << tile) - 1) >> tile, (width + (1 << tile) - 1) >> tile
            bits.write(1, 1)
            bits.write(PREDICTOR, 2)
            bits.write(tile - 2, 3)
            _write_pixels(bits, np.full(shape[0] * shape[1], chosen << 8 | OPAQUE_BLACK, np.uint32), shape[1], 0, False, None, 0)
    bits.write(0, 1)  # no more transforms
    if found is None:
        found = references(flat, np.zeros(len(flat), np.int8))
    data, refers = _write_greys([bits], flat, np.array([len(flat)]), width, found, 0 if "predictor" in used else 255)[0]
    return data, used + ["references"] * refers


def encode_greys(data: np.ndarray, sizes: np.ndarray, width: int) -> list[tuple[bytes, list[str]]]:
    """encode_grey() of images that lie one after the other, so many samples each in rows of width: those that need
    neither a palette nor a predictor are written together."""
    ends = np.cumsum(sizes)
    image = np.repeat(np.arange(len(sizes)), sizes)
    found = references(data, image)
    counts = np.bincount(image * 256 + data, minlength=256 * len(sizes)).reshape(-1, 256)
    own = (((counts > 0).sum(1) <= 16) & (sizes > 64)) | (_entropy_bits(counts) - CODE_BITS > ROUGH_BITS * sizes)
    out: list = [None] * len(sizes)
    for k in np.flatnonzero(own).tolist():
        a, b = int(ends[k] - sizes[k]), int(ends[k])
        cut = slice(*np.searchsorted(found[0], [a, b]))
        out[k] = encode_grey(data[a:b].reshape(-1, width), (found[0][cut] - a, found[1][cut], found[2][cut]))
    if len(rest := np.flatnonzero(~own)):
        keep, of = ~own[image], ~own[image[found[0]]]
        moved = np.cumsum(keep) - 1
        heads = [_head(width, int(size) // width, False) for size in sizes[rest]]
        for bits in heads:
            bits.write(0, 1)  # no transforms
        made = _write_greys(heads, data[keep], sizes[rest], width, (moved[found[0][of]], found[1][of], found[2][of]), 255)
        for k, (media, refers) in zip(rest.tolist(), made, strict=True):
            out[k] = media, ["references"] * refers
    return out


def encode(
    image: np.ndarray, *, predictor_modes: np.ndarray | None = None, cross: np.ndarray | None = None, green: bool = False, palette: bool = False, tile_bits: int = 2, cache_bits: int = 0, references: bool = True, meta: np.ndarray | None = None
) -> bytes:
    """An ARGB image with the transforms asked for, pixel by pixel: for small images and for tests.

    predictor_modes and cross hold a value for each tile (modes, or ARGB elements); meta the group of each tile.
    """
    height, width = image.shape
    channels, now = _channels(image.ravel(), width).copy(), width
    bits = _head(width, height, bool((image >> 24 != 255).any()))
    if palette:
        colours = np.unique(image)
        if len(colours) > 256:
            raise ValueError("too many colours")
        table = _channels(colours, len(colours))[0]
        bits.write(1, 1)
        bits.write(PALETTE, 2)
        bits.write(len(colours) - 1, 8)
        _write_pixels(bits, _flat(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), 0, False, None, 0)
        index, pack = np.searchsorted(colours, image), _bundle_bits(len(colours))
        if pack:
            now = (width + (1 << pack) - 1) >> pack
            each = 8 >> pack
            index = np.pad(index, ((0, 0), (0, (now << pack) - width))).reshape(height, now, 1 << pack)
            index = (index << (each * np.arange(1 << pack))).sum(-1)
        channels = _channels((index.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE_BLACK)).ravel(), now).copy()
    across = (now + (1 << tile_bits) - 1) >> tile_bits
    if predictor_modes is not None:
        bits.write(1, 1)
        bits.write(PREDICTOR, 2)
        bits.write(tile_bits - 2, 3)
        _write_pixels(bits, (predictor_modes.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE_BLACK)).ravel(), across, 0, False, None, 0)
        channels = predictor(channels, predictor_modes, tile_bits, False)
    if cross is not None:
        bits.write(1, 1)
        bits.write(CROSS_COLOUR, 2)
        bits.write(tile_bits - 2, 3)
        _write_pixels(bits, cross.astype(np.uint32).ravel(), across, 0, False, None, 0)
        cross_colour(channels, np.ascontiguousarray(_tiles(_channels(cross.ravel(), across), tile_bits, now, height)), False)
    if green:
        bits.write(1, 1)
        bits.write(SUBTRACT_GREEN, 2)
        subtract_green(channels, False)
    bits.write(0, 1)
    _write_pixels(bits, _flat(channels), now, cache_bits, references, meta, tile_bits, main=True)
    return _file(bits.bits())


def _write_pixels(bits: BitWriter, flat: np.ndarray, width: int, cache_bits: int, references: bool, meta: np.ndarray | None, tile_bits: int, main: bool = False) -> None:
    pixels = [int(x) for x in flat]
    bits.write(int(cache_bits > 0), 1)
    if cache_bits:
        bits.write(cache_bits, 4)
    if main:
        bits.write(int(meta is not None), 1)
        if meta is not None:
            bits.write(tile_bits - 2, 3)
            _write_pixels(bits, (meta.astype(np.uint32) << np.uint32(8) | np.uint32(OPAQUE_BLACK)).ravel(), meta.shape[1], 0, False, None, 0)
    size = (1 << cache_bits) if cache_bits else 0
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEAR)))}
    cache, seen, items, at = [0] * size, {}, [], 0
    while at < len(pixels):
        c, length, distance = pixels[at], 0, 0
        if references and at >= 1:
            for start in seen.get(tuple(pixels[at : at + 3]), ()):
                n = 0
                while at + n < len(pixels) and n < 4096 and pixels[start + n] == pixels[at + n]:
                    n += 1
                if n > length:
                    length, distance = n, at - start
        slot = (CACHE_FACTOR * c & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            items.append((at, "reference", (length, near.get(distance, distance + len(NEAR)))))
        elif cache_bits and cache[slot] == c and at:
            items.append((at, "cache", slot))
            length = 1
        else:
            items.append((at, "literal", c))
            length = 1
        for k in range(at, at + length):
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            seen.setdefault(tuple(pixels[k : k + 3]), []).append(k)
        at += length
    group_of = (lambda p: 0) if meta is None else lambda p: int(meta[p // width >> tile_bits, p % width >> tile_bits])
    n_groups = 1 if meta is None else int(meta.max()) + 1
    sizes = (256 + LENGTH_CODES + size, 256, 256, 256, DISTANCE_CODES)
    counts = [[[0] * n for n in sizes] for _ in range(n_groups)]
    symbols = []
    for p, kind, value in items:
        if kind == "literal":
            row = [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        elif kind == "cache":
            row = [(0, 256 + LENGTH_CODES + value, 0, 0)]
        else:
            a, b = prefixed(value[0]), prefixed(value[1])
            row = [(0, 256 + a[0], *a[1:]), (4, *b)]
        symbols.append((group_of(p), row))
        for k, s, _, _ in row:
            counts[group_of(p)][k][s] += 1
    lengths = [[limited_lengths(c) for c in g] for g in counts]
    for g in lengths:
        for row in g:
            if sum(map(bool, row)) == 1 and row.index(1) >= 256:
                row[0] = 1  # simple codes can't hold large symbols
            write_prefix_code(bits, row)
    codes = [[canonical_codes(row) for row in g] for g in lengths]
    for g, row in symbols:
        for k, s, extra, n in row:
            if sum(map(bool, lengths[g][k])) > 1:
                bits.write(codes[g][k][s], lengths[g][k][s])
            bits.write(extra, n)
