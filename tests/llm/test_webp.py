"""Round trips through every feature of the lossless WebP codec, and payloads of many sizes."""

import numpy as np
import pytest

from veldt.llm import media, webp


def picture(seed, height=13, width=19, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32), (height, width))
    base = rng.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
    base[3:6] = base[0:3]
    base[:, 6:9] = base[:, 2:5]
    return base


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("references", [False, True])
def test_cache_and_references(cache_bits, references):
    for seed in range(3):
        image = picture(seed, colours=7)
        assert np.array_equal(webp.decode(webp.encode(image, cache_bits=cache_bits, references=references)), image)


def test_transforms():
    rng = np.random.default_rng(1)
    image = picture(2)
    tiles = (4, 5)
    modes = np.arange(20).reshape(tiles) % 14
    cross = rng.integers(0, 1 << 32, tiles, dtype=np.uint64).astype(np.uint32)
    for options in ({"predictor_modes": modes}, {"cross": cross}, {"green": True}, {"predictor_modes": modes, "cross": cross, "green": True, "cache_bits": 4}):
        assert np.array_equal(webp.decode(webp.encode(image, **options)), image), options


@pytest.mark.parametrize("mode", range(14))
def test_every_predictor(mode):
    image = picture(mode, 9, 10)
    modes = np.full((3, 3), mode)
    assert np.array_equal(webp.decode(webp.encode(image, predictor_modes=modes)), image)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette_and_bundling(colours):
    image = picture(3, 11, 21, colours)
    assert np.array_equal(webp.decode(webp.encode(image, palette=True)), image)


def test_meta_codes():
    image = picture(4)
    meta = np.arange(20).reshape(4, 5) % 3
    assert np.array_equal(webp.decode(webp.encode(image, meta=meta, cache_bits=3)), image)


def test_known_file():
    """A 1 x 1 image put together by hand from the format's description: one opaque pixel, red 255."""
    bits = webp.BitWriter()
    for value, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        bits.write(value, n)
    for symbol in (0, 255, 0, 255, 0):
        bits.write(1, 1)
        bits.write(0, 1)
        bits.write(int(symbol > 1), 1)
        bits.write(symbol, 8 if symbol > 1 else 1)
    assert webp.decode(webp._file(bits.bits())).tolist() == [[0xFFFF0000]]


def test_near_distances_are_the_formats():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:10] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1)]
    assert webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_broken_streams_raise():
    good = webp.encode_grey(np.random.default_rng(0).integers(0, 99, (4, 64)).astype(np.uint8))[0]
    for broken in (b"", good[:10], good[:-20], b"RIFX" + good[4:]):
        with pytest.raises(ValueError):
            webp.decode(broken)


def test_payloads():
    rng = np.random.default_rng(5)
    skewed = np.repeat(np.arange(256), np.minimum(2 ** np.arange(256, dtype=float), 4000).astype(int)).astype(np.uint8)
    for text in (b"", b"a", b"a" * 64, b"ab" * 500, bytes(range(256)), rng.bytes(5000), skewed.tobytes(), "žluťoučký kůň\n".encode() * 99, b"x" * ((1 << 20) + 65), rng.bytes((1 << 20) + 65 * 64)):
        payload = media.payload_of(text)
        assert len(payload) % 64 == 0 and payload.startswith(text) and len(payload) >= 64
        assert b"".join(i.tobytes() for i in media.load(media.store(payload)[0])) == payload


GREY = {
    "": lambda rng: rng.integers(0, 256, 6400),
    "palette": lambda rng: rng.choice([48, 49, 50, 51, 52, 53], 6400),
    "predictor": lambda rng: np.cumsum(rng.integers(-2, 3, 6400)) % 256,
    "references": lambda rng: np.tile(rng.integers(0, 256, 700), 12)[:6400],
    "palette,references": lambda rng: np.tile(rng.choice([7, 9, 200], 1100), 6)[:6400],
    "predictor,references": lambda rng: np.tile(np.cumsum(rng.integers(-15, 16, 1600)), 4) % 256,
}


@pytest.mark.parametrize("coding", GREY)
def test_grey_images_use_what_shortens_them(coding, monkeypatch):
    """Each feature is chosen where it helps, the file is shorter than prefix codes alone, and it is read the same by the
    array decoder, stretch by stretch, and by the one that goes pixel by pixel."""
    rng = np.random.default_rng(8)
    samples = GREY[coding](rng).astype(np.uint8).reshape(-1, 64)
    data, used = webp.encode_grey(samples)
    assert ",".join(sorted(used)) == coding
    image = samples.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    assert np.array_equal(webp.decode(data), image)
    if coding:
        assert len(data) < len(webp.encode(image, references=False))
    monkeypatch.setattr(webp, "STRETCH", 300)
    assert np.array_equal(webp.decode(data), image)
    monkeypatch.setattr(webp, "_grey_pixels", lambda bits, codes, total, width: webp._pixel_by_pixel(bits, [codes], total, width, 0, None, 0, 0) >> np.uint32(8) & np.uint32(255))
    assert np.array_equal(webp.decode(data), image)


def test_references_of_a_run():
    """References stay in their document and their block, never overlap, and copy what stands before them."""
    rng = np.random.default_rng(2)
    texts = [b"abcdefgh" * 40, rng.bytes(300) * 3, b"abcdefgh" * 3, b"", b"x" * 9000, rng.bytes(50)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    start, length, far = webp.references(data, doc)
    assert len(start) > 5 and (np.diff(start) >= length[:-1]).all() and length.max() == webp.MAX_REFERENCE
    for s, n, d in zip(start.tolist(), length.tolist(), far.tolist(), strict=True):
        assert doc[s - d] == doc[s + n - 1] and all(data[s + k] == data[s + k - d] for k in range(n))


def test_equal_texts_are_stored_equally_wherever_they_stand():
    """Also where a block of the search for references would end inside a text."""
    rng = np.random.default_rng(4)
    word = rng.bytes(40)
    payload = media.payload_of(b"".join(word + rng.bytes(9) for _ in range(4000)))
    before = media.payload_of(rng.bytes(webp.BLOCK - len(payload) // 2))
    alone = media.store_run([payload])[0]
    parts = [before[at : at + 64000] for at in range(0, len(before), 64000)]
    assert "references" in alone[1] and media.store_run([*parts, payload, payload])[-2:] == [alone, alone]


def run_of_payloads(seed):
    """Prose of many lengths, texts that need a palette or a predictor, code lengths of 1 to 15, long and short texts."""
    rng = np.random.default_rng(seed)
    words = [rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8).tobytes() for _ in range(400)]
    texts = [b" ".join(words[k % 400] for k in rng.zipf(1.3, rng.integers(1, 900)).tolist()) for _ in range(150)]
    texts += [b"", b"a" * 40, b"ab" * 500, bytes(range(256)) * 3, np.repeat(np.arange(20), 2 ** np.arange(20) // 8).astype(np.uint8).tobytes()]
    texts += [rng.bytes(n) for n in (1, 64, 500, 30000)] + [GREY[c](rng).astype(np.uint8).tobytes() for c in GREY]
    texts += [b"x" * ((1 << 20) + 65), texts[0] * 90, texts[1], texts[1]]
    return [media.payload_of(texts[k]) for k in rng.permutation(len(texts))]


@pytest.mark.parametrize("seed", range(6))
def test_images_of_a_run_are_coded_side_by_side(seed, monkeypatch):
    """The same files as one by one, and the same samples back, with few files decoded one by one."""
    payloads = run_of_payloads(seed)
    stored = media.store_run(payloads)
    assert stored == [media.store(p) for p in payloads] and {"", "palette", "predictor", "references"} <= {",".join(used) for _, used in stored}
    alone, decode = [], webp.decode
    monkeypatch.setattr(webp, "decode", lambda data: alone.append(data) or decode(data))
    back = media.load_run([m for m, _ in stored])
    assert [b"".join(i.tobytes() for i in images) for images in back] == payloads
    assert all(i.dtype == np.uint8 and i.shape[1] == media.ROW for images in back for i in images)
    assert len(alone) < 40 < len(payloads) - 100
    monkeypatch.setattr(media, "RUN_IMAGES", 50)
    assert media.store_run(payloads) == stored
    assert [b"".join(i.tobytes() for i in images) for images in media.load_run([m for m, _ in stored])] == payloads


def test_images_of_any_width_are_decoded_side_by_side():
    rng = np.random.default_rng(3)
    images = [np.tile(rng.integers(0, 60, width), 40).astype(np.uint8).reshape(-1, width) for width in range(20, 80)]
    files = [webp.encode_grey(i)[0] for i in images]
    assert all(np.array_equal(a, b) for a, b in zip(webp.decode_greens(files), images, strict=True))


def test_broken_streams_in_a_run_raise():
    rng = np.random.default_rng(6)
    files = [webp.encode_grey(rng.integers(0, 40, (9, 64)).astype(np.uint8))[0] for _ in range(40)]
    for broken in (files[7][:-60], b"RIFX" + files[7][4:], files[7][:60]):
        with pytest.raises(ValueError):
            webp.decode_greens([*files[:7], broken, *files[8:]])


def test_hand_made_stream_with_references():
    """Eight grey pixels, put together by hand: two literals, then a reference of six pixels at distance 2."""
    bits = webp.BitWriter()
    for value, n in ((0x2F, 8), (7, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        bits.write(value, n)
    lengths = [0] * 280
    lengths[65], lengths[66], lengths[256 + 4] = 2, 2, 1  # symbol 4: lengths 5 and 6
    webp.write_prefix_code(bits, lengths)
    for symbol in (0, 0, 255, 4):  # distance symbol 4: codes 5 and 6; 6 is two pixels to the left
        bits.write(1, 1)
        bits.write(0, 1)
        bits.write(int(symbol > 1), 1)
        bits.write(symbol, 8 if symbol > 1 else 1)
    codes = webp.canonical_codes(lengths)
    for value, n in ((codes[65], 2), (codes[66], 2), (codes[260], 1), (1, 1), (1, 1)):
        bits.write(value, n)
    assert ((webp.decode(webp._file(bits.bits())) >> 8) & 255).tolist() == [[65, 66] * 4]
