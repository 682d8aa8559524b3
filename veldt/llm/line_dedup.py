"""Line dedup: drop lines that many documents share, but for one document of each.

Native: explode the normalised lines, hash them, count documents per hash, and reassemble what stays by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import BROADCAST_ROWS, fresh, id_key, lower_ascii, materialize, small

#: A line is hot if over one in so many documents holds it; so hot lines are at most that many times the lines of a document.
HOT_SHARE = 1000
SPACES = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """Array of the keys of all lines: ASCII white space stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(lower_ascii(text), "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)))


def _hashes(key: Column) -> list[Column]:
    """128 bits in two differently seeded halves."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with two more columns and text_col without shared lines.

    Keys of at least min_chars code points found in at least min_docs documents (distinct ids) lose all their
    lines except those in the largest id that holds them. Adds n_lines (before dropping) and n_dropped.
    A null or empty text is one empty line and keeps its value. Rows with one id are one document where documents are
    counted, and each keeps its own lines; a null id is the smallest id. Other columns pass through, whatever they are
    called; an empty table gives an empty table.

    Keys are compared by 128-bit hashes. Hot lines: keys are made distinct within a row and counted with map-side
    aggregation; lines that over one in HOT_SHARE documents hold, which are few, are marked by broadcast, the others too
    where they were counted to be few, else by a shuffle in which no line is hot.
    """
    doc, text1, text2, lines, drops, n_lines, n_dropped = fresh(docs, "dedup_id", "dedup_h1", "dedup_h2", "dedup_lines", "dedup_drops", "n_lines", "n_dropped")
    whole_text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows, several = docs.groupBy(id_key(docs[id_col])).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)) > 1).first()
    # Positions belong to a row: to its id, and to its text where several rows have one id.
    row = {doc: id_key(docs[id_col])} | ({text1: F.xxhash64(whole_text), text2: F.xxhash64(F.lit(7), whole_text)} if several else {})
    base = docs.select(*[c.alias(n) for n, c in row.items()], whole_text.alias("t"))
    long_key = F.length("k") >= min_chars
    seen = base.select(doc, F.explode(F.array_distinct(line_keys(F.col("t")))).alias("k")).where(long_key).select(doc, *_hashes(F.col("k")))
    if several:
        seen = seen.distinct()  # several rows of one id are one document
    shared = materialize(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max(doc).alias("keeper")).where(F.col("n") >= min_docs))
    placed = base.select(*row, F.posexplode(line_keys(F.col("t"))).alias("p", "k")).where(long_key).select(*row, "p", *_hashes(F.col("k")))

    def marked(some: DataFrame, few: int) -> DataFrame:
        return placed.join(small(some, few), ["h1", "h2"]).where(F.col(doc) < F.col("keeper")).select(*row, "p")

    n_shared = shared.count()
    marks = shared.select("h1", "h2", "keeper")
    if n_shared <= BROADCAST_ROWS:
        found = marked(marks, n_shared)
    else:
        is_hot = F.col("n") > rows // HOT_SHARE
        hot = shared.where(is_hot).select("h1", "h2", "keeper")
        found = marked(hot, hot.count())
        placed = placed.join(small(hot, hot.count()), ["h1", "h2"], "left_anti")
        found = found.union(marked(shared.where(~is_hot).select("h1", "h2", "keeper"), n_shared))
    dropped = found.groupBy(*row).agg(F.collect_set("p").alias(drops))
    # Lines are split before the join so that they are a plain column afterwards and are looked up by position.
    cut = docs.withColumns({**row, lines: F.split(whole_text, "\n", -1)})
    joined = cut.drop(*([text_col] if not docs.columns.count(text_col) > 1 else [])).join(dropped, list(row), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(F.col(drops), F.array().cast("array<int>")))
    at = joined.withColumn(drops, F.when(F.col(drops).isNotNull(), stay))
    whole = F.array_join(lines, "\n")
    kept = F.when(F.col(drops).isNull(), whole).otherwise(F.array_join(F.transform(drops, lambda i: F.col(lines)[i]), "\n"))
    out = [kept.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    count = F.size(lines).cast("long")
    return at.select(*out, count.alias(n_lines), (count - F.coalesce(F.size(F.when(F.col(drops).isNotNull(), F.col(drops))).cast("long"), count)).alias(n_dropped))
