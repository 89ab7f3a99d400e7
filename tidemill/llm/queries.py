"""Queries over the corpus, with SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table
from . import packing, subjects, tokens

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


# 7. Encoding of the whole corpus


@query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(_documents(spark, sf_dir).select("doc_id", "text"))


@query()
def p7_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, tokens and characters per source."""
    counts = tokens.token_counts(_documents(spark, sf_dir).withColumn("chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")), ["source", "chars"])
    return counts.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum("chars").alias("chars"))


# 8. Filling fixed-capacity windows


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(_documents(spark, sf_dir), ["doc_id", "source"])
    return packing.pack_windows(counts, table(spark, sf_dir, "context_windows"))


@query()
def p8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


@query()
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf_dir))


# 9. Subject area of each text


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = subjects.fit(documents, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))
    return subjects.subject_areas(spread(documents.select("doc_id", "text")), model)


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


@query()
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts per subject and source: the corpus composition by subject."""
    found = _subjects(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return found.groupBy("subject", "source").agg(F.count(F.lit(1)).alias("texts"), F.round(F.avg("share"), 6).alias("mean_share"))
