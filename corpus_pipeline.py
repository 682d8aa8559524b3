"""A corpus pipeline out of five operators: each stage works on all rows that the one before it kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Every row goes by its own verdict, whatever its doc_id: rows with a null id or one id of several are judged, compared and
mixed each. Null and empty texts have no words, are no copies of each other, and are left to the classifier; an empty
table stays empty; columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm.common import importable, materialize
from veldt.llm.jaccard import jaccard_components
from veldt.llm.line_dedup import line_dedup
from veldt.llm.mixing import mix_sources
from veldt.llm.packing import pack_documents
from veldt.llm.quality_classifier import classify, page_sites

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    importable(spark)
    sites = page_sites(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"))
    return classify(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), sites, keep_text=True).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go; what a document is left with is its text."""
    cut = line_dedup(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the least id. Documents without words are no copies."""
    keyed = materialize(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()))
    groups = jaccard_components(keyed, id_col="row_key", k=5, percent=80, count_links=False)
    ids = keyed.select("row_key", "doc_id")
    groups = materialize(groups.join(ids, "row_key"))
    first = groups.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first"))
    kept = first.select("first.row_key").union(groups.where("n_shingles = 0").select("row_key"))
    return keyed.join(kept, "row_key", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix_sources(docs.select(*COLUMNS), keep_text=True).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; a row for each piece."""
    importable(spark)
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the classifier's fit nor the tokenizer can be put into SQL. Tests hold the lines, near copies, mix and packed
#: pieces against brute force, and the classifier's posteriors and verdicts against plain Python from its text scores.
ORACLE_SQL = None
