"""Best-fit packing of token sequences by local search.

Documents are cut into pieces of at most the capacity and dealt evenly to bounded packing groups. A group starts from best
fit in the order its pieces come in, which leaves underfull bins; local search then takes the emptiest bins apart: it
moves documents, or exchanges one for one and two for one, into fuller bins, which raises the sum of squared fills, until
bins empty or no bin has such a change left. If that is not the least number of bins that the total length allows, a
second start, by decreasing length, is searched as well, and the fewer bins stay. What stands in bins that are still
underfull meets again in a second round, so groups cost at most a few sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import discard, fresh, materialize
from veldt.llm.tokens import DEFAULT_VOCABULARY, encode_runs, text_runs

#: Pieces that one packing group holds at most, on average.
GROUP_PIECES = 50_000
#: Texts over so many characters are encoded as overlapping chunks; the memo of words holds shorter ones.
HUGE_CHARS = 1 << 17
#: Bins with at least this much room meet again in the next round.
LOOSE_ROOM = 32


def best_fit(lengths: list[int], capacity: int, order: list[int]) -> list[list[int]]:
    """Bins (lists of positions) by best fit of the positions in that order; rooms are found in a bit set."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for i in order:
        n = lengths[i]
        free = mask >> n
        if free:
            room = n + (free & -free).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - n
        rooms[left].append(b)
        if left:
            mask |= 1 << left
    return bins


class OpenBins:
    """Underfull bins, found by their room, and their items, found by their reach: the longest item that could take the
    item's place. Items of one reach stand by length; shortest[r] is the least length of those with reach r."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.rooms: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.mask = 0
        self.reach: list[dict[int, set[tuple[int, int]]]] = [{} for _ in range(capacity + 1)]
        self.shortest = np.full(capacity + 1, capacity + 1, np.int64)

    def add(self, b: int, items: list[int], room: int) -> None:
        self.rooms[room].add(b)
        self.mask |= 1 << room
        for i in items:
            n = self.lengths[i]
            self.reach[n + room].setdefault(n, set()).add((b, i))
            if n < self.shortest[n + room]:
                self.shortest[n + room] = n

    def remove(self, b: int, items: list[int], room: int) -> None:
        self.rooms[room].discard(b)
        if not self.rooms[room]:
            self.mask &= ~(1 << room)
        for i in items:
            n = self.lengths[i]
            some = self.reach[n + room][n]
            some.discard((b, i))
            if not some:
                del self.reach[n + room][n]
                self.shortest[n + room] = min(self.reach[n + room], default=self.capacity + 1)

    def with_room(self, n: int) -> int | None:
        """The least room of n or more that a bin has."""
        free = self.mask >> n
        return n + (free & -free).bit_length() - 1 if free else None

    def exchange(self, n: int) -> tuple[int, int] | None:
        """(room left, item length) of the exchange of a length n for a shorter item that fills that item's bin best."""
        if n > self.capacity:
            return None
        fits = self.shortest[n:] < n
        k = int(fits.argmax())
        return (k, int(self.shortest[n + k])) if fits[k] else None


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Fewer bins, if changes between underfull ones that increase the sum of squared fills can empty some.

    The emptiest bin gives what it can to others: a document moves to the fullest bin that has room, else one document,
    else two, are exchanged for a shorter one so that the other bin has the least room left. Every change is the best of
    all open bins and takes length out of a bin into one that is fuller afterwards, so the search ends: when a pass over
    all open bins changes nothing, or when the bins are as few as the total length allows.
    """
    least = -(-sum(lengths) // capacity)
    fills = {k: sum(lengths[i] for i in b) for k, b in enumerate(bins) if b}
    held = {k: list(bins[k]) for k in fills}
    index = OpenBins(lengths, capacity)
    for k, f in fills.items():
        if f < capacity:
            index.add(k, held[k], capacity - f)
    changed = True
    while changed and len(fills) > least:
        changed = False
        queue = [(f, k) for k, f in fills.items() if f < capacity]
        heapq.heapify(queue)
        while queue and len(fills) > least:
            f, a = heapq.heappop(queue)
            if fills.get(a) != f or f == capacity:
                continue  # it was changed meanwhile; the next pass sees it
            index.remove(a, held[a], capacity - f)
            while held[a] and (found := _best_change(index, lengths, held[a], fills[a])):
                give, b, take = found
                index.remove(b, held[b], capacity - fills[b])
                gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                held[a] = [i for i in held[a] if i not in give] + take
                held[b] = [i for i in held[b] if i not in take] + give
                fills[a] -= gain
                fills[b] += gain
                if fills[b] < capacity:
                    index.add(b, held[b], capacity - fills[b])
                changed = True
            if not held[a]:
                del held[a], fills[a]
            else:
                index.add(a, held[a], capacity - fills[a])
    return [held[k] for k in sorted(held)]


def _best_change(index: OpenBins, lengths: list[int], items: list[int], fill: int) -> tuple[list[int], int, list[int]] | None:
    """(given, bin, taken) of the change that leaves another bin with the least room; None if none raises the squared fills."""
    capacity, best, change = index.capacity, None, None
    one_each = list({lengths[i]: i for i in items}.items())
    for n, i in one_each:
        room = index.with_room(n)
        if room is not None and capacity - room + n > fill and (best is None or room - n < best):
            best, change = room - n, ([i], room, None)
    if change is not None:
        return change[0], next(iter(index.rooms[change[1]])), []
    options = [(n, [i]) for n, i in one_each]
    for some in (options, None):
        if some is None:  # two for one, if no exchange of one is left
            order = sorted(items, key=lengths.__getitem__)
            pairs = {lengths[i] + lengths[j]: [i, j] for at, i in enumerate(order) for j in order[at + 1 :] if lengths[i] + lengths[j] <= capacity}
            some = list(pairs.items())
        for n, give in some:
            found = index.exchange(n)
            if found and capacity - found[0] > fill and (best is None or found[0] < best):
                best, change = found[0], (give, n + found[0], found[1])
        if change is not None:
            b, i = next(iter(index.reach[change[1]][change[2]]))
            return change[0], b, [i]
    return None


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: local search from best fit in the given order, and from decreasing order where it helps."""
    least = -(-sum(lengths) // capacity)
    bins = local_search(lengths, best_fit(lengths, capacity, list(range(len(lengths)))), capacity)
    if len(bins) > least:
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        other = local_search(lengths, best_fit(lengths, capacity, order), capacity)
        bins = other if len(other) < len(bins) else bins
    return bins


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, chunk_chars: int = HUGE_CHARS) -> DataFrame:
    """One row per piece: pack_id (id_col), piece, start, length, ids_crc32 (and ids as bytes with keep_ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    stop = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for run in text_runs(batch.column(1)):
                rows: list[list] = [[] for _ in range(6)]
                for ids, _ in encode_runs(run, vocabulary, chunk_chars):
                    ids += stop
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        for column, value in zip(rows, (at, p, s // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            column.append(value)
                    at += 1
                names = ["pack_id", "piece", "start", "length", "ids_crc32"]
                arrays = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *[pa.array(x, pa.int64()) for x in rows[2:5]]]
                if keep_ids:
                    names, arrays = [*names, "ids"], [*arrays, pa.array(rows[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"pack_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(cut, schema)


def _pack_group(capacity: int, level: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row_hash", "piece"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].astype(int).tolist()
        sequence, offset, fill = [0] * len(rows), [0] * len(rows), [0] * len(rows)
        for k, held in enumerate(pack_lengths(lengths, capacity)):
            total, at = sum(lengths[i] for i in held), 0
            for i in held:
                sequence[i], offset[i], fill[i] = (level << 60) + (int(key[0]) << 32) + k, at, total
                at += lengths[i]
        return rows.assign(sequence_id=sequence, offset=offset, fill=fill)

    return pack


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (with a column length, at most the capacity) with sequence_id and offset, gapless from 0 in each sequence.

    Groups are dealt by a hash that repeated rows don't share. It is drawn once, when the pieces are written."""
    own = F.xxhash64(*[f"`{c}`" for c in pieces.columns if c != "ids"], F.monotonically_increasing_id())
    hashed = materialize(pieces.withColumn("row_hash", own))
    count = hashed.count()
    groups = max(1, -(-count // group_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema) + ", sequence_id long, offset long, fill long"
    names = hashed.columns
    first = hashed.withColumn("pack_group", F.pmod("row_hash", F.lit(groups))).groupBy("pack_group")
    first = first.applyInPandas(lambda key, rows: _pack_group(capacity, 0)(key, rows[names]), schema)
    if groups == 1:
        return first.drop("row_hash", "fill")
    first = materialize(first)
    discard(hashed)
    tight = first.where(F.col("fill") > capacity - LOOSE_ROOM)
    loose = first.where(F.col("fill") <= capacity - LOOSE_ROOM).select(*names)
    again = max(1, -(-loose.count() // group_pieces))
    second = loose.withColumn("pack_group", F.pmod(F.xxhash64("row_hash"), F.lit(again))).groupBy("pack_group")
    second = second.applyInPandas(lambda key, rows: _pack_group(capacity, 1)(key, rows[names]), schema)
    return tight.unionByName(second).drop("row_hash", "fill")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    A document is its ids and end_id; a longer one than the capacity is cut, with the last piece shorter. Returns one
    row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids). Null and empty
    texts are end_id alone. Repeated rows are documents each. Other columns are left out; a result column that has the name
    of id_col gets another one; an empty table gives an empty table.
    """
    packed = pack_pieces(token_pieces(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, capacity=capacity, end_id=end_id, keep_ids=keep_ids), capacity=capacity, group_pieces=group_pieces)
    shown = [c for c in packed.columns if c != "pack_id"]
    return packed.select(F.col("pack_id").alias(id_col), *[F.col(c).alias(n) for c, n in zip(shown, fresh(docs.select(f"`{id_col}`"), *shown), strict=True)])
