"""References to parents that are missing, not yet loaded, or already deleted.

The parent table is first reduced to one validity interval per key (earliest load, earliest deletion). References and
intervals are then co-partitioned by key, sorted, and walked once side by side: a sort-merge join, asked for by hint so that
both streams are only ever read in order and neither is held in memory. A key that a third of all references share would land
in one task, so references are first counted per key (combined before the shuffle); a key of more than ``HOT`` references is
spread over as many partitions as it has times ``HOT``, by the reference's own key, and its interval is repeated once for each.
All other keys have one partition and one interval.

Defined results: null and blank references are no cases; keys match character by character; a parent without any load time
is never late; a reference without load time is a case only if its parent is missing (its month is then null); repeated
reference rows give repeated cases; with an empty parent table every filled reference is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import utc_month
from ..functions.text import is_blank
from ..sizes import measured

HOT = 200_000


def validity_intervals(parents: DataFrame, key: str, loaded_at: str, deleted_at: str) -> DataFrame:
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("parent_key"))
        .agg(F.min(loaded_at).alias("valid_from"), F.min(deleted_at).alias("valid_to"))
    )


def orphans(
    references: DataFrame,
    row_key: str,
    reference: str,
    parents: DataFrame,
    parent_key: str,
    source: str,
    loaded_at: str = "loaded_at",
    deleted_at: str = "deleted_at",
    hot: int = HOT,
) -> DataFrame:
    """source_table, row_key, loaded_month and reason (``missing``, ``late``, ``deleted``) of each broken reference."""
    refs = references.select(F.col(row_key).cast("string").alias("row_key"), F.col(reference).alias("ref"), F.col(loaded_at).alias("seen_at"))
    refs = refs.where(F.col("ref").isNotNull() & ~is_blank("ref"))
    intervals = validity_intervals(parents, parent_key, loaded_at, deleted_at)
    counts = refs.groupBy(F.col("ref").alias("hot_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    salts = measured(counts.select("hot_key", F.ceil(F.col("n") / hot).cast("int").alias("salts")))
    spread = lambda d, key: d.join(salts, F.col(key) == F.col("hot_key"), "left").withColumn("salts", F.coalesce("salts", F.lit(1))).drop("hot_key")
    refs = spread(refs, "ref").withColumn("salt", F.pmod(F.xxhash64("row_key"), F.col("salts")).cast("int")).drop("salts")
    intervals = spread(intervals, "parent_key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    merged = refs.join(intervals.hint("merge"), (refs["ref"] == intervals["parent_key"]) & (refs["salt"] == intervals["salt"]), "left")
    reason = (
        F.when(F.col("parent_key").isNull(), "missing")
        .when(F.col("valid_from") > F.col("seen_at"), "late")
        .when(F.col("valid_to") <= F.col("seen_at"), "deleted")
    )
    return merged.select(F.lit(source).alias("source_table"), "row_key", utc_month("seen_at").alias("loaded_month"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    return found.groupBy("source_table", "loaded_month", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
