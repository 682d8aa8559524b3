"""Readers of text files as relations of text columns; the empty string is null."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.sources.relation import Relation

#: A quoted file of up to so many bytes is read by one task, whatever its quotes hold.
ONE_TASK_BYTES = 64 << 20


def hadoop_path(spark: SparkSession, path: str):
    """The file system and path objects for a path in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return bool(fs.exists(p))


def read_text(spark: SparkSession, path: str) -> str:
    """All of a small file."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _text_relation(df: DataFrame, names: list[str]) -> Relation:
    cleaned = df.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in df.columns])
    return Relation(cleaned, tuple(names), ("text",) * len(names))


def _schema(n: int) -> T.StructType:
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted file must be read as a whole: it is small, or some line has an odd number of quotes, as every line
    has in which a field with a line end begins."""
    fs, p = hadoop_path(spark, path)
    if fs.getContentSummary(p).getLength() <= ONE_TASK_BYTES:
        return True
    return not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()


def read_separated(spark: SparkSession, path: str, sep: str, quoted: bool, multiline: bool | None = None) -> Relation:
    """CSV (quotes, doubled quotes, line ends in quotes) and TSV (no quoting). The header line names the columns.

    multiline: whether line ends may stand in quotes, which keeps a file in one task; None looks into large files."""
    if multiline is None:
        multiline = quoted and spans_lines(spark, path)
    options = {"sep": sep, "multiLine": multiline and quoted, "quote": '"' if quoted else "", "escape": '"' if quoted else "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "PERMISSIVE"}
    head = spark.read.options(**options).csv(path).limit(1).collect()
    names = [re.sub(r'["\r﻿]', "", x or "") for x in (head[0] if head else [])]
    if not names:
        return Relation(spark.createDataFrame([], _schema(1)), ("",), ("text",))
    df = spark.read.options(**options, header=True, enforceSchema=True).schema(_schema(len(names))).csv(path)
    return _text_relation(df, names)


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """All lines but the header, and the header: the first line of each file. The CSV reader, which knows where a file
    begins, reads them as one field each."""
    first = spark.read.text(path).limit(1).collect()
    header = (first[0][0] if first else "").lstrip("﻿").rstrip("\r")
    whole = {"sep": "\x00", "quote": "", "escape": "", "header": True, "enforceSchema": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "PERMISSIVE"}
    lines = spark.read.options(**whole).schema("value string").csv(path)
    rows = lines.select(F.regexp_replace("value", "[\r﻿]", "").alias("value")).where(F.trim("value") != "")
    return rows, header


def read_wsv(spark: SparkSession, path: str) -> Relation:
    """Fields separated by any run of white space; blanks around a line don't count."""
    rows, header = _lines(spark, path)
    names = header.split()
    parts = F.split(F.trim("value"), r"\s+")
    return _text_relation(rows.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(f"c{i}") for i in range(len(names))]), names)


def read_col(spark: SparkSession, path: str) -> Relation:
    """Fixed width: a column starts where its word in the header does."""
    rows, header = _lines(spark, path)
    starts = [m.start() for m in re.finditer(r"\S+", header)]
    names = [m[0] for m in re.finditer(r"\S+", header)]

    def cut(i: int) -> Column:
        start = 0 if i == 0 else starts[i]
        width = starts[i + 1] - start if i + 1 < len(starts) else 1 << 30
        return F.rtrim(F.substring("value", start + 1, width)).alias(f"c{i}")

    return _text_relation(rows.select(*[cut(i) for i in range(len(names))]), names)


READERS = {
    "csv": lambda spark, path, multiline: read_separated(spark, path, ",", True, multiline),
    "tsv": lambda spark, path, multiline: read_separated(spark, path, "\t", False),
    "wsv": lambda spark, path, multiline: read_wsv(spark, path),
    "col": lambda spark, path, multiline: read_col(spark, path),
}
