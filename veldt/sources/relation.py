"""What a FROM item resolves to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.values import kind_of
from veldt.sources.snapshots import snapshot


@dataclass(frozen=True)
class Relation:
    """Columns with their dialect names (repeats allowed) and kinds; the DataFrame has one column for each, in order.

    generated: calendar or sequence for tables that are made from bounds; then there is no DataFrame yet. rowid: the
    DataFrame's last column, if that holds the row numbers of the table it is a copy of. in_order: queries get the rows by
    file name and place in the file, for tables whose files Spark would read the largest first. ordered: a sub-query's
    rows, in the order of a sort, which deals them out to tasks anew each time it runs.
    """

    df: DataFrame | None
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    generated: str | None = None
    rowid: str | None = None
    in_order: bool = False
    ordered: bool = False


def relation_of(df: DataFrame, names: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None, text: bool = False) -> Relation:
    return Relation(df, tuple(names or df.columns), tuple(kinds or [kind_of(f.dataType, text) for f in df.schema.fields]))


def numbered(df: DataFrame, name: str, ordered: bool = False) -> DataFrame:
    """df with a 0-based row number in its physical order, without moving rows.

    Rows of files are numbered by file name, then by place in the file, whatever tasks Spark reads them in; rows of other
    DataFrames by partition. One count for each split of a file (or partition) is summed up, and joined by broadcast: it
    is a row for each task that reads the table. What comes ordered from a sort is written first and numbered as written,
    since the counts must hold for the very partitions that they are joined to.
    """
    if ordered:
        df = snapshot(df).toDF(*df.columns)
    part, split, start = f"{name}_part", f"{name}_split", f"{name}_start"
    number = F.monotonically_increasing_id()
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias(part), F.col("_metadata.file_block_start").alias(split), number.alias(name))
        marked.schema  # noqa: B018  raises where there are no files
    except AnalysisException:
        marked = df.select("*", number.alias(name)).withColumns({part: F.shiftright(name, 33), split: F.lit(0)})
    counts = marked.groupBy(part, split).agg(F.count(F.lit(1)).alias("count"), F.min(name).alias("low"))
    before = F.sum("count").over(Window.orderBy(part, split).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(part, split, (F.coalesce(before, F.lit(0)) - F.col("low")).alias(start))
    placed = marked.join(F.broadcast(starts), [part, split])
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.col(start)).alias(name))
