"""Generated tables: CALENDAR and SEQUENCE from derived bounds, SAMPLE, DIR and inline VALUES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions import dates as D
from veldt.sources.files import hadoop_path
from veldt.sources.relation import Relation, relation_of

#: Rows that SEQUENCE has from its lower bound on without an upper bound, when a LIMIT stops it.
SEQUENCE_ROWS = 10_000_000

CALENDAR = Relation(None, tuple(D.CALENDAR), tuple(k for k, _ in D.CALENDAR.values()), "calendar")
SEQUENCE = Relation(None, ("value",), ("int",), "sequence")


def sequence(spark: SparkSession, low: int, high: int, step: int = 1) -> DataFrame:
    """value from low to high - 1."""
    return spark.range(low, max(high, low), step).toDF("value")


def calendar(spark: SparkSession, low: int, high: int) -> DataFrame:
    """The calendar of the Julian days low to high - 1, within the years 1 to 9999."""
    low = max(low, D.FIRST_DAY + D.JULIAN_EPOCH)
    high = min(high, D.LAST_DAY + D.JULIAN_EPOCH + 1)
    day = spark.range(low, max(high, low)).select(D.date_of_julian(F.col("id")).alias("d"))
    return day.select(*[f(F.col("d")).alias(name) for name, (_, f) in D.CALENDAR.items()])


def sample(spark: SparkSession, rows: int = 1000, seed: int = 1) -> DataFrame:
    """id (increasing, gaps 1 to 10), name, birth_date and score from a seed; without a sequential state, so in parallel."""
    syllables = F.array(*[F.lit(s) for s in ("Ada", "Bo", "Cy", "Dee", "Eli", "Fay", "Gus", "Hal", "Ina", "Jo")])
    pick = lambda k: F.element_at(syllables, (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(10)) + 1).cast("int"))
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(n))
    return spark.range(rows).select(
        (F.col("id") * 10 + draw(0, 9)).alias("row_id"),
        F.concat(pick(1), F.lit(" "), F.upper(F.concat(pick(2), pick(3)))).alias("name"),
        F.date_from_unix_date((F.lit(D.FIRST_DAY) + F.pmod(F.col("id") * 1664525 + seed, F.lit(1 << 20))).cast("int")).alias("birth_date"),
        draw(4, 100).alias("score"),
    ).withColumnRenamed("row_id", "id")


def directory(spark: SparkSession, path: str) -> Relation:
    """inode, name, type (d, f or s), path, size, created, modified of what is below a path, or of the file itself; stores
    know no inode or creation time. The listing is the store's own, as Spark's readers take it."""
    fs, top = hadoop_path(spark, path)
    found, todo = [], [top] if fs.exists(top) else []
    while todo:
        for x in fs.listStatus(todo.pop()):
            p = x.getPath()
            found.append((p.getName(), "s" if x.isSymlink() else "d" if x.isDirectory() else "f", p.toString(), x.getLen(), x.getModificationTime()))
            if x.isDirectory():
                todo.append(p)
    df = spark.createDataFrame(sorted(found, key=lambda x: x[2]), "name string, type string, path string, size long, at long")
    none = F.lit(None)
    return relation_of(df.select(none.cast("long").alias("inode"), "name", "type", "path", "size", none.cast("timestamp").alias("created"), F.timestamp_millis("at").alias("modified")))


def values(spark: SparkSession, rows: list[list[object]]) -> Relation:
    """Inline rows as text columns col1, col2, ..."""
    n = len(rows[0])
    shown = lambda x: str(int(x)) if isinstance(x, float) and x.is_integer() and abs(x) < 1e15 else str(x)
    plain = [[None if x is None or x == "" else shown(x) for x in row] for row in rows]
    df = spark.createDataFrame(plain, ", ".join(f"c{i} string" for i in range(n)))
    kinds = ["int" if all(isinstance(r[i], int) for r in rows) else "text" for i in range(n)]
    df = df.select(*[F.col(f"c{i}").cast("long").alias(f"c{i}") if kinds[i] == "int" else F.col(f"c{i}") for i in range(n)])
    return Relation(df, tuple(f"col{i + 1}" for i in range(n)), tuple(kinds))
