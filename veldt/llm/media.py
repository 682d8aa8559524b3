"""Media columns: payloads stored as lossless WebP, decoded again, with pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import webp
from veldt.llm.common import fresh
from veldt.llm.tokens import text_runs

ROW = 64
#: Samples that one image holds; longer payloads are stored as several files in a row.
IMAGE_SAMPLES = ROW * webp.MAX_SIDE
#: Images that are coded side by side.
RUN_IMAGES = 2048


def payload_of(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def store(payload: bytes) -> tuple[bytes, list[str]]:
    """The payload as grey images with rows of 64 samples, and the features of the format that they use."""
    parts, used = [], []
    for at in range(0, len(payload), IMAGE_SAMPLES):
        some = np.frombuffer(payload, np.uint8, min(IMAGE_SAMPLES, len(payload) - at), at)
        media, features = webp.encode_grey(some.reshape(-1, ROW))
        parts.append(media)
        used += features
    return b"".join(parts), sorted(set(used))


def store_run(payloads: list[bytes]) -> list[tuple[bytes, list[str]]]:
    """store() of each payload; those of one image are written together, so many at once."""
    out = [store(p) if len(p) > IMAGE_SAMPLES else None for p in payloads]
    single = [k for k, made in enumerate(out) if made is None]
    for at in range(0, len(single), RUN_IMAGES):
        some = single[at : at + RUN_IMAGES]
        data = np.frombuffer(b"".join(payloads[k] for k in some), np.uint8)
        for k, (media, used) in zip(some, webp.encode_greys(data, np.array([len(payloads[k]) for k in some]), ROW), strict=True):
            out[k] = media, sorted(used)
    return out


def _images(media: bytes) -> list[bytes]:
    files, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        files.append(media[at:end])
        at = end
    return files


def load(media: bytes) -> list[np.ndarray]:
    """The images of a stored payload, height x width of 8-bit samples each."""
    return [(webp.decode(file) >> np.uint32(8)).astype(np.uint8) for file in _images(media)]


def load_run(stored: list[bytes]) -> list[list[np.ndarray]]:
    """load() of each stored payload; those of one image are decoded together, so many at once."""
    files = [_images(media) for media in stored]
    out = [load(media) if len(own) != 1 else None for media, own in zip(stored, files, strict=True)]
    single = [k for k, images in enumerate(out) if images is None]
    for at in range(0, len(single), RUN_IMAGES):
        some = single[at : at + RUN_IMAGES]
        for k, image in zip(some, webp.decode_greens([files[k][0] for k in some]), strict=True):
            out[k] = [image]
    return out


def features(samples: np.ndarray) -> str:
    """Mean and variance in thousandths, distinct values, and the shares of eight equal ranges in thousandths."""
    counts = np.bincount(samples, minlength=256)
    n, values = len(samples), np.arange(256)
    total, squares = int(counts @ values), int(counts @ values**2)
    mean, variance = 1000 * total // n, 1000 * (squares * n - total * total) // (n * n)
    shares = (1000 * counts.reshape(8, 32).sum(1) // n).tolist()
    return f"{mean}:{variance}:{int((counts > 0).sum())}:" + ",".join(map(str, shares))


def media_columns(docs: DataFrame, *, text_col: str = "text", keep_media: bool = True, keep_pixels: bool = True) -> DataFrame:
    """docs without text_col, with the media column's size and digests, and features from the pixels read back.

    Adds n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, coding (the features of
    the format that the file uses: palette, predictor, references; none: prefix codes alone), and with keep_media media
    (binary), with keep_pixels height, width and pixels (binary rows of 8-bit samples, as decoded). A null text counts
    as empty; its payload is 64 bytes 0. Equal texts give equal values. Other columns pass through; an empty table gives
    an empty table. No shuffle; a worker holds one Arrow batch and the arrays of about 2 MB of payloads.
    """
    new = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "coding"]
    types = ["long", "long", "string", "long", "long", "string", "string", "string"]
    if keep_media:
        new, types = [*new, "media"], [*types, "binary"]
    if keep_pixels:
        new, types = [*new, "height", "width", "pixels"], [*types, "int", "int", "binary"]
    others = [c for c in docs.columns if c != text_col]
    names = fresh(docs.drop(text_col), *new)
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for run in text_runs(batch.column(0)):
                rows = []
                stored = store_run([payload_of(t) for t in run])
                for text, (media, used), images in zip(run, stored, load_run([media for media, _ in stored]), strict=True):
                    samples = images[0].ravel() if len(images) == 1 else np.concatenate([i.ravel() for i in images])
                    back = samples.tobytes()
                    row = [len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), ",".join(used)]
                    if keep_media:
                        row.append(media)
                    if keep_pixels:
                        row += [len(samples) // ROW, ROW, back]
                    rows.append(row)
                arrays = [pa.array(x, arrow[t]) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i + 1).slice(at, len(run)) for i in range(len(others))], *arrays], names=[*others, *names])
                at += len(run)

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], *[f"`{n}` {t}" for n, t in zip(names, types, strict=True)]])
    return docs.select(F.col(f"`{text_col}`").cast("string").alias(text_col), *[f"`{c}`" for c in others]).mapInArrow(convert, schema)
