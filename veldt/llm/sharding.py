"""Sharding by sampled splitters: near-equal bytes for every shard, equal texts together where they fit.

Size-weighted samples of the keys give the boundaries of many small ranges; the ranges' exact bytes are summed,
overfull ranges are subdivided by samples of their own until each of them holds one key, and shards are runs of whole
ranges.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import fresh, materialize

#: Samples for each range, so that a range's bytes vary little, and rows that one range holds on average.
SAMPLES_A_RANGE = 8
LEAST_RANGES, MOST_RANGES = 2048, 1 << 17
RANGE_ROWS = 50_000
#: A range is overfull with so many times the mean bytes.
OVERFULL = 4
LEAST, MOST = -(2**63), 2**63 - 1


def _packed(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Pairs of longs as 16 bytes whose order is that of the pairs."""
    out = np.empty((len(k1), 2), ">u8")
    out[:, 0] = k1.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = k2.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S16").ravel()


def _splitters(k1: np.ndarray, k2: np.ndarray, ranges: int) -> np.ndarray:
    """Boundaries at the quantiles of the samples. A boundary stands before all rows of its text, unless the text was
    sampled so often that it spans whole ranges; then it stands inside."""
    order = np.lexsort((k2, k1))
    k1, k2 = k1[order], k2[order]
    at = np.unique(np.linspace(0, len(k1), ranges + 1).astype(int)[1:-1])
    first, second = k1[at], k2[at].copy()
    new = np.ones(len(at), bool)
    new[1:] = first[1:] != first[:-1]
    second[new] = LEAST
    return np.unique(_packed(first, second))


def _within(got: pd.DataFrame, share: float) -> list[tuple[int, int]]:
    """Boundaries from sampled keys (k1, k2, bytes) of overfull ranges, a sample standing for share bytes or its own.

    One stands before each key, and one behind a key that is so heavy that it is always sampled; they move out to the
    ends of the key's text unless the text's samples span whole ranges.
    """
    out = []
    k1, k2, size = (got.iloc[:, i].to_numpy(np.int64).tolist() for i in range(3))
    text: dict[int, float] = {}
    for a, n in zip(k1, size, strict=True):
        text[a] = text.get(a, 0) + max(n, share)
    for a, b, n in zip(k1, k2, size, strict=True):
        whole = text[a] < SAMPLES_A_RANGE * share
        out.append((a, LEAST if whole else b))
        if n >= share and not whole and b < MOST:
            out.append((a, b + 1))
        elif n >= share and a < MOST:
            out.append((a + 1, LEAST))
    return out


def _middle(low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """A boundary with the lower of two keys before it and the higher behind it, half-way between them."""
    if low[0] < high[0]:
        return (low[0] + high[0]) // 2 + 1, LEAST
    return low[0], (low[1] + high[1]) // 2 + 1


def _ranges_of(splitters: np.ndarray):
    def range_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, _packed(k1.to_numpy(), k2.to_numpy()), "right").astype(np.int64))

    return F.pandas_udf(range_of, "long")


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, ranges: int | None = None, samples: int | None = None) -> DataFrame:
    """docs without text_col, with size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    Size is the UTF-8 bytes of the text (null: none) plus 1; shards have near-equal sums of sizes. Rows are ordered by
    the hash of their text, then of their id, so equal texts are in one shard unless they span whole ranges. Keys come
    from the data alone, so reruns agree. Null ids, ties, repeated rows and an empty table need nothing special; other
    columns pass through.

    Only samples, so many for each range, and one sum for each range reach the driver, and one place for each range is
    broadcast. Ranges grow with the rows up to MOST_RANGES, so all of that is bounded; larger ranges hold more rows each,
    which are sorted by one task a range and spill.
    """
    spark = docs.sparkSession
    size, crc, shard, slot, k1, k2, part, start = fresh(docs, "size", "text_crc32", "shard", "slot", "shard_k1", "shard_k2", "shard_range", "shard_start")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    keyed = materialize(
        docs.select(
            *others,
            (F.octet_length(text).cast("long") + 1).alias(size),
            F.when(docs[text_col].isNull(), F.lit(0)).otherwise(F.crc32(text.cast("binary"))).cast("long").alias(crc),
            F.xxhash64(text).alias(k1),
            F.xxhash64(F.lit(11), F.coalesce(docs[id_col].cast("string"), F.lit("null"))).alias(k2),
        )
    )
    total, rows = keyed.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    ranges = ranges or min(max(LEAST_RANGES, rows // RANGE_ROWS), MOST_RANGES)
    samples = samples or SAMPLES_A_RANGE * ranges

    def drawn(frame: DataFrame, seed: int, rate: float) -> pd.DataFrame:
        uniform = (F.pmod(F.xxhash64(F.lit(seed), k2, k1), F.lit(1 << 30)) / float(1 << 30)).cast("double")
        return frame.where(uniform < F.col(size) * F.lit(rate)).select(k1, k2, size).toPandas()

    def ranged(splitters: np.ndarray) -> DataFrame:
        return keyed.withColumn(part, _ranges_of(splitters)(k1, k2)) if len(splitters) else keyed.withColumn(part, F.lit(0).cast("long"))

    got = drawn(keyed, 1, samples / max(total, 1))
    splitters = _splitters(got[k1].to_numpy(np.int64), got[k2].to_numpy(np.int64), ranges) if len(got) else np.zeros(0, "S16")
    share = total / (SAMPLES_A_RANGE * ranges)
    # Every round halves the span of keys of each overfull range at least, so one is left with a single key in the end.
    for again in itertools.count(2):
        sums = ranged(splitters).groupBy(part).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(part)
        over = sums[(sums["bytes"] > OVERFULL * total / ranges) & (sums["n"] > 1)]
        if not len(over):
            break
        table = spark.createDataFrame([(int(x),) for x in over[part]], f"`{part}` long")
        keys = materialize(ranged(splitters).join(F.broadcast(table), part).groupBy(part, k1, k2).agg(F.sum(size).alias(size)))
        spans = keys.groupBy(part).agg(F.min(F.struct(k1, k2)).alias("low"), F.max(F.struct(k1, k2)).alias("high")).where("low < high")
        middles = [_middle(tuple(r["low"]), tuple(r["high"])) for r in spans.select("low", "high").collect()]
        if not middles:
            break
        more = np.array(middles + _within(drawn(keys, again, 1 / share), share), np.int64)
        splitters = np.unique(np.concatenate([splitters, _packed(more[:, 0], more[:, 1])]))
    if int(sums["n"].sum()) != rows:
        raise RuntimeError("the ranges' rows are not those of the table")
    # Shards are runs of ranges: each ends with the range whose end is nearest to its share of all bytes.
    ends = np.cumsum(sums["bytes"].to_numpy(np.int64)) if len(sums) else np.zeros(0, np.int64)
    cuts = [0]
    for i in range(1, shards):
        at = int(np.searchsorted(ends, total * i / shards))
        nearer = at < len(ends) and (at == 0 or ends[at] - total * i / shards <= total * i / shards - ends[at - 1])
        cuts.append(max(cuts[-1], min(at + int(nearer), len(ends))))
    place = np.searchsorted(np.array(cuts[1:]), np.arange(len(ends)), "right")
    table = sums.assign(**{shard: place})[[part, shard, "n"]]
    table[start] = table.groupby(shard)["n"].cumsum() - table["n"]
    schema = f"`{part}` long, `{shard}` int, `{start}` long"
    placed = spark.createDataFrame(list(zip(*(table[c].tolist() for c in (part, shard, start)), strict=True)), schema)
    inner = Window.partitionBy(part).orderBy(k1, k2, *[F.col(f"`{c}`") for c in docs.columns if c == id_col])
    numbered = ranged(splitters).withColumn(slot, F.row_number().over(inner).cast("long") - 1)
    joined = numbered.join(F.broadcast(placed), part)
    return joined.select(*others, size, crc, shard, (F.col(start) + F.col(slot)).alias(slot))
