"""N-gram Jaccard join: rare-first prefix filtering, components of the links, and the number of links of each class.

Documents with equal shingle sets are one class. Each class puts the rarest of its shingles, as many as two linked
sets must share one of, into posting lists. Lists are first compared against one pivot each; classes that are then
connected need no comparison any more. Two such rounds leave the pairs of unconnected classes that share a prefix
shingle; those are all compared, but for pairs that an earlier round refused. Length, positional and suffix filters stand
before every comparison.

Links never leave a component, so the links are then counted inside the components: each is dealt into blocks of classes
by hash, and every two blocks meet once, where each pair of different classes that the length filter leaves is verified
by its whole sets. Components of two classes are their one link. What leaves the blocks is one count for each class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm import words as W
from veldt.llm.common import WORD_SLICE_BYTES, discard, id_key, materialize, small, text_slices

#: Shingle counts are summed in 2 to this power buckets; what is sent to the executors has this size for any input.
ORDER_BITS = 18
PIVOT_ROUNDS = 2
#: Shingles, and classes, that a block of one component holds on average at most.
BLOCK_SHINGLES, BLOCK_CLASSES = 1 << 16, 512
#: Cells of the matrix of classes by shingles that is multiplied at once.
CELLS = 1 << 23
#: Shared prefix shingles (a long each) that may be broadcast.
SHARED_ROWS = 2_000_000


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a run."""
    starts, ends, first = W.word_bounds(data, offsets)
    hashes = W.word_hashes(data, starts, ends)
    for i in range(len(offsets) - 1):
        yield W.document_shingles(hashes[first[i] : first[i + 1]], k)


def _digest(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit digests of a set, the first by a seed."""
    if not len(shingles):
        return 0, 0
    with np.errstate(over="ignore"):
        both = np.array([W.mix(shingles ^ np.uint64(0x9E6C63D0876A9A47 * (seed + 1) & (1 << 64) - 1)).sum(), W.mix(shingles ^ np.uint64(0xC2B2AE3D27D4EB4F)).sum()], np.uint64)
        both = W.mix(both + np.uint64(len(shingles)))
    return tuple(both.view(np.int64).tolist())


def _first_pass(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "n", "d1", "d2"]
        counts = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            ids = batch.column(1)
            for at, end, data, offsets in text_slices(batch, 0, WORD_SLICE_BYTES):
                rows, seen = [], []
                for shingles in _sets(data, offsets, k):
                    seen.append(shingles >> np.uint64(64 - ORDER_BITS))
                    rows.append((len(shingles), *_digest(shingles, seed)))
                counts += np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(counts))
                arrays = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(end - at, np.int32)), ids.slice(at, end - at), *arrays], names=names)
        used = np.flatnonzero(counts)
        zero = pa.array(np.zeros(len(used), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(counts[used]), zero, zero], names=names)

    return run


def least_overlap(a: int, percent: int) -> int:
    """The least number of shingles that a set of a shares with any set it is linked with."""
    return -(-percent * a // 100)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """For the suffix filter: the hash space in as many parts as there are shingles, a power of 2 and 64 at least, and of
    each part whether it holds an odd number of them. Sets differ by no fewer shingles than their bits differ."""
    size = max(64, 1 << max(len(shingles) - 1, 0).bit_length())
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _prefix_pass(k: int, seed: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        done: set[int] = set()
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for at, _, data, offsets in text_slices(batch, 0, WORD_SLICE_BYTES):
                rows = []
                for i, shingles in enumerate(_sets(data, offsets, k)):
                    if not len(shingles) or (d1 := _digest(shingles, seed)[0]) in done:
                        continue
                    done.add(d1)
                    n = len(shingles)
                    ranks = counts[(shingles >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]
                    size = n - least_overlap(n, percent) + 1
                    first = np.argsort(ranks, kind="stable")[:size]  # ties by hash: the set is sorted
                    rows.append((d1, ids[at + i], n, shingles[first].view(np.int64), parity_bits(shingles)))
                if rows:
                    c, rep, n, tokens, bits = zip(*rows, strict=True)
                    lists = [pa.array(x, pa.list_(pa.int64())) for x in (tokens, bits)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (c, rep, n)], *lists], names=["c", "rep", "n", "tokens", "bits"])

    return run


def _set_pass(k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, 0, WORD_SLICE_BYTES):
                sets = list(_sets(data, offsets, k))
                c = pa.array([_digest(s, seed)[0] for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([c, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["c", "shingles"])

    return run


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x shares with each of y."""
    nx = len(x)
    sizes = [len(s) for s in [*x, *y]]
    whole = np.concatenate([*x, *y])
    names, token = np.unique(whole, return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    out = np.zeros((nx, len(y)), np.int64)
    width = max(1, CELLS // len(sizes))
    for at in range(0, len(names), width):  # float32 counts up to 2^24 without loss
        low, high = np.searchsorted(token, (at, at + width))
        cells = np.zeros((len(sizes), min(width, len(names) - at)), np.float32)
        cells[row[low:high], token[low:high] - at] = 1
        out += (cells[:nx] @ cells[nx:].T).astype(np.int64)
    return out


def _block_links(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The rows that the classes of two blocks (or of one with itself) are linked with."""
        b1, b2 = key[1].as_py(), key[2].as_py()
        block, c, rows = (table.column(x).to_numpy() for x in ("block", "c", "rows"))
        shingles = table.column("shingles").combine_chunks()
        offsets, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
        sets = lambda at: [values[offsets[i] : offsets[i + 1]] for i in at]
        ix, iy = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        counts = np.zeros(len(c), np.int64)
        if len(ix) and len(iy):
            n = np.diff(offsets).astype(np.int64)
            both = n[ix][:, None] + n[iy][None, :]
            shared = shared_counts(sets(ix), sets(iy))
            linked = 100 * shared >= percent * (both - shared)
            if b1 == b2:
                np.fill_diagonal(linked, False)
            counts[ix] = linked @ rows[iy]
            if b1 != b2:
                counts[iy] = rows[ix] @ linked
        return pa.table({"c": c, "linked": counts})

    return run


def _needed(a: Column, b: Column, percent: int) -> Column:
    """Shared shingles that sets of a and b need to be linked."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent) - F.lit(1e-9))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length filter and positional filter for two postings (structs c, n, pos)."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    length = F.lit(100) * F.least(nx, ny) >= F.lit(percent) * F.greatest(nx, ny)
    return length & (F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos")) >= _needed(nx, ny, percent))


def _near_enough(percent: int) -> Column:
    """Suffix filter: the parity bits of sets x and y, folded to the shorter of both, are not too far apart."""
    width = F.least(F.size("bx"), F.size("by"))
    fold = lambda bits: F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, width), F.lit(0).cast("long"), lambda a, j: a.bitwiseXOR(F.col(bits)[j]))
    )
    apart = F.aggregate(F.zip_with(fold("bx"), fold("by"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    return apart <= F.col("nx") + F.col("ny") - 2 * _needed(F.col("nx"), F.col("ny"), percent)


def components(links: DataFrame) -> DataFrame:
    """(c, comp): every class in links (x, y) with the least class it is connected with.

    Labels spread to neighbours and jump along labels, until none changes; rounds grow with the logarithm of the
    longest chain. Everything stays distributed.
    """
    edges = materialize(links.select("x", "y").union(links.select("y", "x")).distinct())
    labels = written = materialize(edges.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("l")).select("c", F.least("c", "l").alias("comp")))
    while True:
        near = edges.join(labels, edges["y"] == labels["c"]).groupBy("x").agg(F.min("comp").alias("l"))
        spread = labels.join(near, labels["c"] == near["x"]).select("c", "comp", F.least("comp", "l").alias("new"))
        jump = labels.select(F.col("c").alias("new"), F.col("comp").alias("beyond"))
        stepped = materialize(spread.join(jump, "new", "left").select("c", F.least("new", F.coalesce("beyond", "new")).alias("comp"), F.col("comp").alias("old")))
        changed = not stepped.where("comp <> old").isEmpty()
        discard(written)
        labels, written = stepped.select("c", "comp"), stepped
        if not changed:
            discard(edges)
            return labels


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_shingles (size of its set), component_id, class_id, and with count_links n_links.

    A set holds the distinct k-word shingles of the text, words being runs of bytes other than ASCII white space with
    A-Z lower-cased; fewer words are one shingle; no words, or null, give an empty set, linked with nothing. Sets link
    when 100 * shared >= percent * union. component_id is the smallest id reachable by links, its own included. Rows
    with equal sets have one class_id. n_links is the number of other rows that a row is linked with: those of its own
    class and all those of the classes linked with it. Repeated ids count by row, a null id as the smallest id (and is shown as null);
    other columns are left out; an empty table gives an empty table.

    Shingles are compared by 64-bit hashes. Classes are told apart by 128 bits; if the first 64 coincide, another seed
    is taken.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), id_key(docs[id_col]).alias("id"))
    for seed in range(8):
        base = materialize(source.mapInArrow(_first_pass(k, seed), "kind int, a long, n long, d1 long, d2 long"))
        rows = base.where("kind = 0").select(F.col("a").alias("id"), "n", F.col("d1").alias("c"), "d2")
        filled = rows.where("n > 0")
        if filled.groupBy("c").agg(F.min(F.struct("n", "d2")).alias("a"), F.max(F.struct("n", "d2")).alias("b")).where("a <> b").isEmpty():
            break
    order = np.zeros(1 << ORDER_BITS, np.int64)
    sums = base.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    order[sums.column("a").to_numpy()] = sums.column("n").to_numpy()
    ordered = spark.sparkContext.broadcast(order)
    one_row_an_id = rows.groupBy("id").count().where("count > 1").isEmpty()
    prefix_type = "c long, rep long, n long, tokens array<long>, bits array<long>"
    once = source.mapInArrow(_prefix_pass(k, seed, percent, ordered), prefix_type)
    prefixes = materialize(once.groupBy("c").agg(*[F.first(x).alias(x) for x in ("rep", "n", "tokens", "bits")]))
    shared = materialize(prefixes.select(F.explode("tokens").alias("t")).groupBy("t").count().where("count > 1").select("t"))
    posts = prefixes.select("c", "n", F.posexplode("tokens").alias("pos", "t")).join(small(shared, shared.count(), SHARED_ROWS), "t")
    posts = materialize(posts.select("t", F.struct("c", "n", "pos").alias("p")))
    discard(shared)
    tested = None

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(c, shingles) of the classes in wanted (c, rep)."""
        reps = wanted.select(F.col("rep").alias("id")).distinct()
        texts = source.join(small(reps, reps.count()), "id", "left_semi").select("t")
        sets = texts.mapInArrow(_set_pass(k, seed), "c long, shingles array<long>")
        if one_row_an_id:
            return sets
        return sets.join(wanted.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.first("shingles").alias("shingles"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that are linked: each pair once in all rounds, by the sets of the classes that it still has."""
        nonlocal tested
        of = lambda v: prefixes.select(F.col("c").alias(v), F.col("n").alias(f"n{v}"), F.col("rep").alias(f"r{v}"), F.col("bits").alias(f"b{v}"))
        new = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["x", "y"], "left_anti")
        near = materialize(new.join(of("x"), "x").join(of("y"), "y").where(_near_enough(percent)).select("x", "y", "rx", "ry"))
        tested = near.select("x", "y") if tested is None else tested.union(near.select("x", "y"))
        wanted = materialize(near.select(F.col("x").alias("c"), F.col("rx").alias("rep")).union(near.select("y", "ry")).distinct())
        sets = materialize(sets_of(wanted))
        both = near.join(sets.select(F.col("c").alias("y"), F.col("shingles").alias("sy")), "y").join(sets.select(F.col("c").alias("x"), F.col("shingles").alias("sx")), "x")
        compared = both.select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("common"), (F.size("sx") + F.size("sy")).alias("sum"))
        found = materialize(compared.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("sum") - F.col("common"))).select("x", "y"))
        discard(sets, wanted)
        return found

    def link_counts(members: DataFrame) -> DataFrame:
        """(c, linked): the rows of other classes that each class of members (c, rows, comp) is linked with."""
        sized = labels.join(prefixes.select("c", "n", "rep"), "c")
        comps = sized.groupBy("comp").agg(F.count(F.lit(1)).alias("many"), F.ceil(F.greatest(F.sum("n") / F.lit(BLOCK_SHINGLES), F.count(F.lit(1)) / F.lit(BLOCK_CLASSES))).cast("int").alias("blocks"))
        sized = materialize(sized.join(comps, "comp").join(members.select("c", "rows"), "c").select("c", "comp", "rep", "rows", "many", "blocks"))
        two = sized.where("many = 2")
        other = two.select(F.col("comp").alias("oc"), F.col("c").alias("other"), F.col("rows").alias("linked"))
        pairs = two.join(other, (F.col("comp") == F.col("oc")) & (F.col("c") != F.col("other"))).select("c", "linked")
        more = sized.where("many > 2")
        block = F.pmod(F.xxhash64(F.lit(5), "c"), F.col("blocks")).cast("int")
        dealt = more.join(sets_of(more), "c").select("c", "comp", "rows", "shingles", "blocks", block.alias("block"))
        dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = dealt.select("comp", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"), "block", "c", "rows", "shingles")
        counted = met.groupBy("comp", "b1", "b2").applyInArrow(_block_links(percent), "c long, linked long")
        return pairs.union(counted).groupBy("c").agg(F.sum("linked").alias("linked"))

    # The first pivot of a list has the fewest rare shingles of its own before the shared one, as an original has among
    # its edited copies. Lists of two are done with that; the others go on.
    heads = posts.groupBy("t").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("p.pos", "p.c", "p.n")).alias("q"))
    first = posts.join(heads, "t").withColumn("link", (F.col("p.c") != F.col("q.c")) & _may_link("p", "q", percent))
    first = materialize(first.where((F.col("m") > 2) | F.col("link")))
    discard(posts)
    posts = first.where("m > 2").select("t", "p")
    pair = (F.least("p.c", "q.c").alias("x"), F.greatest("p.c", "q.c").alias("y"))
    links = verified(first.where("link").select(*pair))
    labels = components(links)
    for step in range(1, PIVOT_ROUNDS + 1):
        now = posts.join(labels.withColumnRenamed("c", "lc"), F.col("p.c") == F.col("lc"), "left").select("t", "p", F.coalesce("comp", "p.c").alias("comp"))
        pick = F.min(F.struct(F.xxhash64(F.lit(step), "comp").alias("drawn"), F.col("p.pos").alias("pos"), "comp", "p"))
        heads = now.groupBy("t").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), pick.alias("q")).where("low < high")
        if step < PIVOT_ROUNDS:
            # later pivots come from a component that the hash draws
            met = now.join(heads.select("t", F.col("q.p").alias("q"), F.col("q.comp").alias("qcomp")), "t").where((F.col("comp") != F.col("qcomp")) & _may_link("p", "q", percent))
        else:
            alive = now.join(heads.select("t"), "t", "left_semi")
            other = alive.select("t", F.col("p").alias("q"), F.col("comp").alias("qcomp"))
            met = alive.join(other, "t").where((F.col("comp") < F.col("qcomp")) & _may_link("p", "q", percent))
        links = links.union(verified(met.select(*pair)))
        labels = components(links)
    discard(first)
    classes = filled.groupBy("c").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    joined = classes.join(labels.withColumnRenamed("c", "lc"), F.col("c") == F.col("lc"), "left").select("c", "least", "rows", F.coalesce("comp", "c").alias("comp"))
    joined = materialize(joined)
    tops = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    table = joined.join(tops, "comp").select("c", "component_id", "rows")
    if count_links:
        table = table.join(link_counts(joined), "c", "left").select("c", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = rows.join(table, "c", "left")
    links_shown = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    shown = lambda x: F.when(x != F.lit(-(2**63)), x)
    return out.select(shown(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), shown(F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))).alias("component_id"), F.col("c").alias("class_id"), *links_shown)
