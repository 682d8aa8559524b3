"""Mix sources to target weights by hash-threshold histograms.

Native: sum sizes by source and hash bucket, find the bucket where a source's budget ends, refine only that bucket
by the next bits, and filter by the threshold that comes out. Nothing is sorted but buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import discard, fresh, materialize, small

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a document's hash that one level of histograms looks at, and levels.
BITS, LEVELS = 15, 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc: Column) -> Column:
    """60 bits of a document's id (null: of the word null)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size, target of each source of sizes (source, source_size).

    Sources by code point, null last, take the weights in turn and share share * all sizes. A source's target stops at
    cap * its size; the excess is shared anew by weight until none is above. Sorted by how soon they reach the cap, the
    sources before the first that stays below its cap are capped, and the others have the same target for each weight.
    The table has a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") % len(weights)) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", weight.cast("double"))
    ranked = ranked.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("w"))
    total = F.lit(share) * F.sum("source_size").over(every).cast("double")
    capped = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", (total - capped) / (F.sum("w").over(every) - used))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every)
    level = first["level"]
    target = F.when(level.isNull() | (F.col("ratio") <= level), F.col("most")).otherwise(level * F.col("w"))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, keep_text: bool = False
) -> DataFrame:
    """docs (without text_col, but with keep_text) with size, source_size, target and copies (how often the mix takes the
    document).

    Size is the number of words (null text: 0). Every source's documents are all taken floor(target / source_size)
    times, and those whose hash is under the source's threshold once more, so each source's words differ from its
    target by at most half of the document at the threshold. No document is taken more than cap times. The choice
    depends on ids and sizes alone, so reruns agree; rows with one id are taken or left together. A null source is a
    source, sorted last; an empty table gives an empty table; other columns pass through.

    The histogram of a hot source has as many rows as any other, and counts are added up before they are shuffled. The
    table of sources, a row each, is put in order by one task, as the weights ask.
    """
    size, source_size, target, copies, key, h, s = fresh(docs, "size", "source_size", "target", "copies", "mix_key", "mix_hash", "mix_source")
    shown = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col]
    sized = docs.select(*shown, word_count(docs[text_col].cast("string")).alias(size), id_hash(docs[id_col]).alias(h), docs[source_col].cast("string").alias(s))
    sized = materialize(sized)
    rows = sized.select(F.col(s).alias("source"), F.col(h).alias("h"), F.col(size).alias("size"))
    marks = thresholds(rows, weights=weights, share=share, cap=cap)
    n_sources = marks.count()
    marks = marks.select(F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target), "full", "threshold")
    joined = sized.join(small(marks, n_sources), sized[s].eqNullSafe(marks[key]))
    taken = F.col("full") + (F.col(h) < F.col("threshold")).cast("long")
    return joined.select(*shown, size, source_size, target, taken.alias(copies))


def thresholds(rows: DataFrame, *, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """source, source_size, target, full, threshold from rows (source, h, size): see mix_sources."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    now = source_targets(totals, weights=weights, share=share, cap=cap).withColumn("full", F.least(F.floor(ratio), F.lit(cap)).cast("long"))
    now = now.withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    # at: the hash bits found so far; below: the words of the documents under them; over: the words in the bucket itself
    now = materialize(now.withColumns({"at": F.lit(0).cast("long"), "below": F.lit(0).cast("long"), "over": F.col("source_size"), "open": F.lit(True)}))
    n_sources = now.count()
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        marks = now.select(F.col("source").alias("m_source"), "at", "below", "budget").where("open")
        inside = rows.join(small(marks, n_sources), F.col("source").eqNullSafe(F.col("m_source")) & (F.shiftright("h", shift + BITS) == F.col("at")))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("next")).agg(F.sum("size").alias("words"), F.first("below").alias("low"), F.first("budget").alias("most"))
        upto = F.col("low") + F.sum("words").over(Window.partitionBy("source").orderBy("next"))
        ends = buckets.withColumn("upto", upto).where(F.col("upto") > F.col("most")).groupBy(F.col("source").alias("b_source")).agg(F.min(F.struct("next", "words", "upto")).alias("b"))
        before, now = now, now.join(ends, now["source"].eqNullSafe(ends["b_source"]), "left").select(
            "source", "source_size", "target", "full", "budget",
            F.coalesce(F.col("b.next"), F.lit(1 << (BITS * (level + 1))).cast("long")).alias("at"),
            F.coalesce(F.col("b.upto") - F.col("b.words"), F.col("source_size")).alias("below"),
            F.coalesce(F.col("b.words"), F.lit(0)).alias("over"),
            F.col("b").isNotNull().alias("open"),
        )
        now = materialize(now)
        discard(before)
    nearer = F.col("open") & (F.col("below") + F.col("over") - F.col("budget") <= F.col("budget") - F.col("below"))
    everything = F.lit(1 << (BITS * LEVELS)).cast("long")
    return now.select("source", "source_size", "target", "full", F.when(~F.col("open"), everything).otherwise(F.col("at") + nearer.cast("long")).alias("threshold"))
