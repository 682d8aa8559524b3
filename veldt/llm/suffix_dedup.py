"""Suffix dedup: remove every byte that a long enough string covers which also starts earlier in the corpus.

Equal strings of LENGTH bytes hold the same anchor, the least hash of their GRAM-byte grams, at the same place. So all
repeats are found among the suffixes around anchors whose gram occurs twice or more:

1. equal texts: all but the first go as a whole;
2. anchors that occur once in the corpus are dropped (one sum for each gram);
3. anchors whose whole surroundings (all strings through them) occur earlier cover all of them;
4. the other anchors' surroundings are suffix sorted in bounded partitions by a merge sort, in which two suffixes are
   compared by a binary search for their common extension on polynomial prefix hashes and the byte behind it. The
   extensions of neighbours to both sides leave for each anchor the strings that can repeat at all; those are sorted by
   their polynomial hash, and equal ones are verified byte by byte.

Anchors with very many different surroundings (a passage in a third of all documents) are not brought together: their
strings are summed by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import words as W
from veldt.llm.common import BROADCAST_ROWS, discard, fresh, id_key, materialize, small, text_slices

GRAM = 32
#: Repeated grams (a long each) that may be broadcast; surroundings that one partition sorts, and of one anchor.
GRAM_ROWS = 2_000_000
PARTITION_ROWS = 20_000
HOT_ROWS = 8_192


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of a."""
    m, c = a, 1
    while 2 * c <= width:
        m = f(m[:-c], m[c:])
        c *= 2
    return f(m[: len(a) - width + 1], m[width - c :][: len(a) - width + 1])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of a run of documents: document, place, gram hash and hash of the surroundings of each anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(data) < length:
        return none
    width = length - GRAM + 1
    prefix = W.prefix_hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = W.mix(W.substring_hashes(prefix, at, at + GRAM))
    rank = (grams >> np.uint64(32)).astype(np.uint32)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (doc[: len(at)] == doc[GRAM - 1 :]) & (np.diff(offsets)[doc[: len(at)]] >= length)
    rank[~inside] = 0xFFFFFFFF
    least = _slide(rank, width, np.minimum)
    edge = np.zeros(width - 1, np.uint32)
    chosen = np.flatnonzero((rank == _slide(np.concatenate([edge, least, edge]), width, np.maximum)) & inside)
    if not len(chosen):
        return none
    d = doc[chosen]
    left = np.maximum(offsets[d], chosen - (length - GRAM))
    right = np.minimum(offsets[d + 1], chosen + length)
    around = W.mix(W.substring_hashes(prefix, left, right) + W.mix(((chosen - left) * 1000 + right - left).astype(np.uint64)))
    return d, chosen - offsets[d], grams[chosen].view(np.int64), around.view(np.int64)


def _anchor_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for at, _, data, offsets in text_slices(batch, 0):
                d, p, g, c = _anchors(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), pa.array(keys[at + d]), pa.array(p.astype(np.int32))], names=["g", "c", "key", "pos"])

    return run


def _surroundings_pass(length: int):
    """From (packed text, key, places, grams, hot): one row per place with the bytes around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, side = zstandard.ZstdDecompressor(), length - GRAM
        for batch in batches:
            rows: list[tuple] = []
            for packed, key, places in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                text = unpack.decompress(packed)
                rows += [(x["g"], x["hot"], key, x["pos"], min(side, x["pos"]), text[max(0, x["pos"] - side) : x["pos"] + length]) for x in places]
                if len(rows) > 20_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["g", "hot", "key", "pos", "before", "bytes"])

    return run


def _matrix(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The surroundings as rows with the anchor in one column, bytes 0 beyond them; their first and end columns."""
    side = length - GRAM
    before = table.column("before").to_numpy().astype(np.int64)
    values = table.column("bytes").combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks)
    sizes = np.diff(np.frombuffer(values.buffers()[1], np.int32, len(values) + 1 + values.offset)[values.offset :]).astype(np.int64)
    starts = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1 + values.offset)[values.offset : -1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8)
    first = side - before
    columns = np.arange(side + length)
    where = columns[None, :] - first[:, None]
    good = (where >= 0) & (where < sizes[:, None])
    return np.where(good, data[np.where(good, starts[:, None] + where, 0)], 0).astype(np.uint8), first, first + sizes


def _hash_rows(matrix: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of each row, one column more than the matrix."""
    r, _ = W.powers(matrix.shape[1])
    out = np.zeros((len(matrix), matrix.shape[1] + 1), np.uint64)
    np.cumsum((matrix.astype(np.uint64) + np.uint64(1)) * r[: matrix.shape[1]], axis=1, out=out[:, 1:])
    return out


def common_extensions(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, column: int, most: np.ndarray, step: int) -> np.ndarray:
    """How far rows a and b agree from the column on to the right (step 1) or to the left (-1), at most so far: binary
    search on prefix hashes. Both rows' hashes weigh a column alike, so differences need no scaling."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (todo := low < high).any():
        middle = (low + high + 1) // 2
        x, y = (np.full(len(a), column), column + middle) if step > 0 else (column - middle, np.full(len(a), column))
        same = (prefix[a, y] - prefix[a, x]) == (prefix[b, y] - prefix[b, x])
        low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
    return low


def _before(matrix: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, column: int, room: np.ndarray, step: int) -> np.ndarray:
    """Whether the suffix of row a from the column on (to the left with step -1) stands before that of row b: by the byte
    behind their common extension, or by length where one is the beginning of the other."""
    most = np.minimum(room[a], room[b])
    shared = common_extensions(prefix, a, b, column, most, step)
    at = np.minimum(np.maximum(column + shared if step > 0 else column - 1 - shared, 0), matrix.shape[1] - 1)
    return np.where(shared < most, matrix[a, at] < matrix[b, at], room[a] < room[b])


def suffix_order(matrix: np.ndarray, prefix: np.ndarray, group: np.ndarray, column: int, room: np.ndarray, step: int) -> np.ndarray:
    """The rows in order of their groups, and of their suffixes from the column on within a group.

    A merge sort from runs of one row, for all groups at once: a row's place in a merged run is its place in its own plus
    the number of rows of the other before it, found by binary search. Comparisons take a logarithmic number of steps.
    """
    order = np.argsort(group, kind="stable")
    begins = np.flatnonzero(np.diff(group[order], prepend=group[order[:1]] - 1)) if len(order) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(order)))
    start, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max(initial=0):
        place = np.arange(len(order))
        inside = place - start
        run = inside // width
        other = start + (run ^ 1) * width  # the run that this one is merged with
        active = np.flatnonzero((size > width) & (other < start + size))
        own, low = order[active], other[active].copy()
        high = np.minimum(low + width, (start + size)[active])
        first, right = low.copy(), (run[active] & 1) == 1
        while (todo := np.flatnonzero(low < high)).size:
            middle = (low[todo] + high[todo]) // 2
            x, y = own[todo], order[middle]
            # rows of the left run stand before equal ones of the right run
            swap = ~right[todo]
            less = _before(matrix, prefix, np.where(swap, y, x), np.where(swap, x, y), column, room, step)
            goes_on = np.where(swap, less, ~less)
            low[todo] = np.where(goes_on, middle + 1, low[todo])
            high[todo] = np.where(goes_on, high[todo], middle)
        merged = order.copy()
        left_start = start[active] + (run[active] & ~1) * width
        merged[left_start + inside[active] % width + (low - first)] = own
        order, width = merged, 2 * width
    return order


def _reach(matrix: np.ndarray, prefix: np.ndarray, group: np.ndarray, first: np.ndarray, end: np.ndarray, side: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the most bytes left of the anchor, and right of its gram, that any other row of its group shares:
    suffixes (and reversed prefixes) are sorted within groups, and the longest extension is a neighbour's."""
    out = []
    for step in (-1, 1):
        column = side if step < 0 else side + GRAM
        room = np.minimum(side - first, length) if step < 0 else end - side - GRAM
        order = suffix_order(matrix, prefix, group, column, room, step)
        a, b = order[:-1], order[1:]
        most = np.where(group[a] == group[b], np.minimum(room[a], room[b]), 0)
        shared = common_extensions(prefix, a, b, column, most, step)
        best = np.zeros(len(matrix), np.int64)
        np.maximum.at(best, a, shared)
        np.maximum.at(best, b, shared)
        out.append(best)
    return out[0], out[1]


def repeats(group: np.ndarray, key: np.ndarray, pos: np.ndarray, matrix: np.ndarray, first: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and window starts (columns) whose string of length bytes an earlier row of the group has at the same column."""
    side = length - GRAM
    prefix = _hash_rows(matrix)
    left, right = _reach(matrix, prefix, group, first, end, side, length)
    low, high = side - left, side + np.minimum(right - side, 0)
    sequence = np.lexsort((pos, key))  # earlier rows first; the sorts below are stable
    rows_out, columns_out = [], []
    for column in range(side + 1):
        some = sequence[(low[sequence] <= column) & (column <= high[sequence])]
        if len(some) < 2:
            continue
        h = W.mix(prefix[some, column + length] - prefix[some, column]) ^ W.mix(group[some].view(np.uint64))
        order = np.argsort(h, kind="stable")
        new = np.ones(len(some), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
        late = np.flatnonzero(~new)
        a, b = some[order[late]], some[order[head[late]]]
        same = np.ones(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            s = slice(at, at + (1 << 16))
            same[s] = (group[a[s]] == group[b[s]]) & (matrix[a[s], column : column + length] == matrix[b[s], column : column + length]).all(1)
        if not same.all():  # a collision: compare the bytes themselves
            seen: set[tuple[int, bytes]] = set()
            a = []
            for row in some.tolist():
                string = (int(group[row]), matrix[row, column : column + length].tobytes())
                a += [row] * (string in seen)
                seen.add(string)
            a = np.array(a, np.int64)
        rows_out.append(a)
        columns_out.append(np.full(len(a), column))
    if not rows_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows_out), np.concatenate(columns_out)


def _sort_pass(length: int):
    """A partition of whole groups: ranges of starts (key, low, high, both included) of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        matrix, first, end = _matrix(table, length)
        group, key, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "key", "pos"))
        rows, columns = repeats(group, key, pos, matrix, first, end, length)
        order = np.lexsort((columns, rows))
        rows, starts = rows[order], columns[order] - (length - GRAM) + pos[rows[order]]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(rows)) - 1 if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(key[rows[at]]), pa.array(starts[at].astype(np.int32)), pa.array(starts[last].astype(np.int32))], names=["key", "low", "high"])

    return run


def _window_pass(length: int):
    """Every string of the surroundings as two hashes (h1, h2), key and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = length - GRAM
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                table = pa.Table.from_batches([batch.slice(at, 2048)])
                matrix, first, end = _matrix(table, length)
                key, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "pos"))
                prefix, other = _hash_rows(matrix), _hash_rows(W._LOWER[matrix] ^ (matrix >> 3))
                for column in range(side + 1):
                    some = np.flatnonzero((first <= column) & (column + length <= end))
                    _, inverse = W.powers(column + 1)
                    h = [W.mix((x[some, column + length] - x[some, column]) * inverse[column]).view(np.int64) for x in (prefix, other)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, h), pa.array(key[some]), pa.array((pos[some] + column - side).astype(np.int32))], names=["h1", "h2", "key", "start"])

    return run


def _pack_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [pack.compress(t.as_py() or b"") for t in batch.column(0).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *batch.columns[1:]], names=["packed", *batch.schema.names[1:]])


def _cut_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, copy, places, firsts, ranges in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
                text = unpack.decompress(packed)
                n = len(text)
                starts = np.zeros(n + 2, np.int64)
                if copy and n >= length:
                    starts[0], starts[n - length + 1] = 1, -1
                if places:
                    whole = np.setdiff1d(np.array(places, np.int64), np.array(firsts or [], np.int64))
                    low, high = np.maximum(whole - (length - GRAM), 0), np.minimum(whole, n - length)
                    np.add.at(starts, low[low <= high], 1)
                    np.add.at(starts, high[low <= high] + 1, -1)
                for x in ranges or ():
                    starts[x["low"]] += 1
                    starts[x["high"] + 1] -= 1
                begins = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
                cover = np.zeros(n + 2, np.int64)
                np.add.at(cover, begins, 1)
                np.add.at(cover, begins + length, -1)
                gone = np.cumsum(cover[:n]) > 0
                change = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(change > 0), np.flatnonzero(change < 0), strict=True)]
                out.append((n, int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text))
            n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["key", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"],
            )

    return run


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, spans (removed runs of bytes), kept (binary), kept_sha256.

    Removed is every byte of the text's UTF-8 that a string of length bytes covers which also starts earlier: in a
    smaller id, or earlier in the same text; overlaps count, and strings are judged on the input. Null texts are empty;
    a null id is smaller than all others; rows with one id are taken in the order of their texts' hashes, and equal ones
    are copies. Other columns are left out; an empty table gives an empty table.
    """
    if length < GRAM + 2:
        raise ValueError(f"length must be at least {GRAM + 2}")
    (hidden,) = fresh(docs, "dedup_key")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(text.alias("t"), id_key(docs[id_col]).alias("id"), docs[id_col].alias(hidden))
    if docs.groupBy(id_key(docs[id_col])).count().where("count > 1").isEmpty():
        base = base.withColumn("key", F.col("id"))
    else:
        base = materialize(base.orderBy("id", F.xxhash64("t"), F.sha2("t", 256)).withColumn("key", F.monotonically_increasing_id()))
    # Whole texts are equal if their SHA-256 is, for which no collision is known.
    marks = materialize(base.select("key", F.unhex(F.sha2("t", 256)).alias("digest")))
    heads = marks.groupBy("digest").agg(F.min("key").alias("head"))
    copies = materialize(marks.join(heads, "digest").where("key <> head").select("key"))
    n_copies = copies.count()
    discard(marks)
    texts = base.select("t", "key").join(small(copies, n_copies, BROADCAST_ROWS), "key", "left_anti").where(F.octet_length("t") >= length).select("t", "key")
    anchors = texts.mapInArrow(_anchor_pass(length), "g long, c long, key long, pos int")
    twice = materialize(anchors.groupBy("g").count().where("count > 1").select("g"))
    light = materialize(anchors.join(small(twice, twice.count(), GRAM_ROWS), "g"))
    discard(twice)
    firsts = materialize(light.groupBy("g", "c").agg(F.min(F.struct("key", "pos")).alias("f")).select("g", "f.key", "f.pos"))
    groups = firsts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sorted_ones = firsts.join(groups, "g").groupBy("key").agg(F.collect_list(F.struct("pos", "g", (F.col("m") > HOT_ROWS).alias("hot"))).alias("places"))
    packed = texts.mapInArrow(_pack_pass, "packed binary, key long")
    around = packed.join(sorted_ones, "key").select("packed", "key", "places").mapInArrow(_surroundings_pass(length), "g long, hot boolean, key long, pos int, before int, bytes binary")
    around = materialize(around)
    n_around = around.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_around // PARTITION_ROWS))
    ranges = around.where("not hot").repartition(parts, "g").mapInArrow(_sort_pass(length), "key long, low int, high int")
    hot = around.where("hot")
    if not hot.isEmpty():
        strings = hot.mapInArrow(_window_pass(length), "h1 long, h2 long, key long, start int")
        least = strings.groupBy("h1", "h2").agg(F.min(F.struct("key", "start")).alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h1", "h2", "least")
        later = strings.join(least, ["h1", "h2"]).where(F.struct("key", "start") != F.col("least"))
        ranges = ranges.union(later.select("key", F.col("start").alias("low"), F.col("start").alias("high")).distinct())
    per_doc = light.groupBy("key").agg(F.collect_list("pos").alias("places"))
    per_doc = per_doc.join(firsts.groupBy("key").agg(F.collect_list("pos").alias("firsts")), "key", "left")
    per_doc = per_doc.join(ranges.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "key", "left")
    side = per_doc.withColumn("copy", F.lit(False)).unionByName(copies.select("key", F.lit(True).alias("copy")), allowMissingColumns=True)
    every = base.select("t", "key", hidden).mapInArrow(_pack_pass, f"packed binary, key long, `{hidden}` {docs.schema[id_col].dataType.simpleString()}")
    joined = every.join(side, "key", "left").select(hidden, "packed", F.coalesce("copy", F.lit(False)).alias("copy"), "places", "firsts", "ranges")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_cut_pass(length), f"key {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string").withColumnRenamed("key", id_col)
