"""Experiment arms against their controls: normalised settings, lever differences, ownership of runs, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sizes import measured
from .offsets import running_total

# Settings that are bookkeeping, not levers.
NON_LEVER = (
    "out", "run_dir", "val_frac", "val_every", "resume", "data", "smoke", "patience", "min_delta", "patience_frac", "min_steps_frac", "degrade_frac", "warmup", "dropout_default", "seed", "steps",
)


def normal_args(args: Column) -> Column:
    """batch and accum become eff_batch; tokenizer and tok_cache become vocab, the tokenizer's file name."""
    batch, accum = args["batch"], args["accum"]
    eff = F.try_multiply(F.expr("1") * batch.try_cast("bigint"), F.coalesce(F.nullif(accum.try_cast("bigint"), F.lit(0)), F.lit(1)))
    rest = F.map_filter(args, lambda k, v: ~k.isin("batch", "accum", "tokenizer", "tok_cache"))
    empty = F.create_map().cast("map<string,string>")
    with_eff = F.when(batch.isNotNull(), F.create_map(F.lit("eff_batch"), eff.cast("string"))).otherwise(empty)
    has_vocab = F.map_contains_key(args, "tokenizer") | F.map_contains_key(args, "tok_cache")
    name = F.element_at(F.split(F.coalesce(args["tokenizer"], F.lit("")), "/"), -1)
    with_vocab = F.when(has_vocab, F.create_map(F.lit("vocab"), name)).otherwise(empty)
    return F.map_concat(rest, with_eff, with_vocab)


def lever_names(a: Column, b: Column) -> Column:
    """Sorted names of the settings that differ between two normalised maps, bookkeeping excluded; missing equals null."""
    keys = F.array_except(F.array_union(F.map_keys(a), F.map_keys(b)), F.array(*[F.lit(k) for k in NON_LEVER]))
    return F.array_sort(F.filter(keys, lambda k: ~a[k].eqNullSafe(b[k])))


def verdicts(pairs: DataFrame) -> DataFrame:
    """``pairs`` has arm, args, control_args, claimed, inert (arrays of names), accepted; adds touched, undeclared, unchanged and
    confounded."""
    d = pairs.withColumn("touched", lever_names(normal_args(F.col("args")), normal_args(F.col("control_args"))))
    claims = F.transform(F.array_remove("claimed", "code"), lambda k: F.when(k.isin("batch", "accum"), F.lit("eff_batch")).otherwise(k))
    d = d.withColumn("claims", F.array_distinct(claims)).withColumn("undeclared", F.array_sort(F.array_except("touched", "claims"))).withColumn("unchanged", F.array_sort(F.array_except("claims", "touched")))
    many = F.size(F.array_except("touched", "inert")) > 1
    return d.withColumn("confounded", many & ~F.array_contains("claimed", "code") & ~F.coalesce("accepted", F.lit(False)))


def header_args(records: DataFrame) -> DataFrame:
    """producer, file_seq, args (as a map of texts) of each file's header; the earliest record of a repeated header."""
    h = records.select("producer", "file_seq", "rec_id", F.expr("from_json(get_json_object(body, '$.args'), 'map<string,string>')").alias("args")).where("args IS NOT NULL")
    return h.groupBy("producer", "file_seq").agg(F.min_by("args", "rec_id").alias("args"))


def arms(records: DataFrame) -> DataFrame:
    """Every file is an arm whose control is the producer's file before it."""
    w = Window.partitionBy("producer").orderBy("file_seq")
    d = header_args(records).withColumn("control_seq", F.lag("file_seq").over(w)).withColumn("control_args", F.lag("args").over(w))
    return d.withColumn("claimed", F.array(F.lit("lr"), F.lit("batch"))).withColumn("inert", F.array().cast("array<string>")).withColumn("accepted", F.lit(False))


def retention(checkpoints: DataFrame, last: int, every: int) -> DataFrame:
    """``checkpoints`` has family, step, kind, n_bytes, keeper; adds ``keep``: best and other non-step files, the last few of a
    family, every ``every``-th step, and keepers."""
    newest = F.row_number().over(Window.partitionBy("family").orderBy(F.desc_nulls_last("step"), "kind"))
    return checkpoints.withColumn("rank", newest).withColumn(
        "keep", (F.col("kind") != "step") | F.col("step").isNull() | (F.col("rank") <= last) | (F.col("step") % every == 0) | F.coalesce("keeper", F.lit(False))
    )


def longest_prefix(records: DataFrame, present: Column) -> DataFrame:
    """Rows before the first ordinal that is not present, per group of ``grp``; ``records`` has grp and ix."""
    first_gap = records.groupBy("grp").agg(F.min(F.when(~present, F.col("ix"))).alias("gap"))
    return records.join(first_gap.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).where(F.col("gap").isNull() | (F.col("ix") < F.col("gap"))).drop("g", "gap")


def islands(records: DataFrame, size: int | None = None) -> DataFrame:
    """Contiguous runs of ``ix`` per ``grp``: first, last and count, cut to at most ``size`` members."""
    w = Window.partitionBy("grp").orderBy("ix")
    d = records.withColumn("island", F.col("ix") - F.row_number().over(w))
    part = F.lit(0) if size is None else F.floor((F.row_number().over(Window.partitionBy("grp", "island").orderBy("ix")) - 1) / size)
    return d.withColumn("part", part).groupBy("grp", "island", "part").agg(F.min("ix").alias("first_ix"), F.max("ix").alias("last_ix"), F.count(F.lit(1)).alias("n")).drop("island")


def reconciled(records: DataFrame, group: str, order: str, claimed: str, held: str) -> DataFrame:
    """group, state, records and kept: all records where at least as much is held as they claim, else the longest prefix that fits.
    Rows of a group are never gathered: prefix sums run in two levels."""
    sums = records.groupBy(group).agg(F.sum(claimed).alias("total"), F.sum(held).alias("there")).withColumnRenamed(group, "_g")
    placed = running_total(records, order, F.col(claimed), [group], "_before").join(sums, F.col(group).eqNullSafe(F.col("_g")))
    fits = (F.col("there") >= F.col("total")) | (F.col("_before") + F.col(claimed) <= F.col("there"))
    state = F.when(F.col("there") == F.col("total"), "equal").when(F.col("there") > F.col("total"), "trim").otherwise("shrink")
    return placed.groupBy(group, state.alias("state")).agg(F.count_if(fits).alias("records"), F.coalesce(F.sum(F.when(fits, F.col(claimed))), F.lit(0)).alias("kept"))


def scanned_parts(members: DataFrame, group: str, part: str, ix: str) -> DataFrame:
    """group, part, first_ix, last_ix, state, of distinct members: ``trusted``, ``scrambled`` (with holes) or ``overlapping`` parts by order
    of name, and the ``gap`` stretches of the group's members that no trusted part covers (their part is null)."""
    spans = members.groupBy(group, part).agg(F.min(ix).alias("lo"), F.max(ix).alias("hi"), F.count(F.lit(1)).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), "lo", "hi", (F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("whole"))))
    held = spans.groupBy(group).agg(rows.alias("ps"))

    def judge(acc: Column, p: Column) -> Column:
        meets = F.exists(acc, lambda q: (q["state"] == "trusted") & (q["lo"] <= p["hi"]) & (p["lo"] <= q["hi"]))
        state = F.when(~p["whole"], "scrambled").when(meets, "overlapping").otherwise("trusted")
        return F.concat(acc, F.array(F.struct(p["part"].alias("part"), p["lo"].alias("lo"), p["hi"].alias("hi"), state.alias("state"))))

    kinds = members.schema
    empty = F.array().cast(f"array<struct<part:{kinds[part].dataType.simpleString()},lo:{kinds[ix].dataType.simpleString()},hi:{kinds[ix].dataType.simpleString()},state:string>>")
    judged = cut(held.select(group, F.aggregate("ps", empty, judge).alias("ps")))
    parts = judged.select(group, F.inline("ps")).select(group, "part", F.col("lo").alias("first_ix"), F.col("hi").alias("last_ix"), "state")
    trusted = judged.select(F.col(group).alias("_g"), F.filter("ps", lambda q: q["state"] == "trusted").alias("ok"))
    free = members.select(group, ix).distinct().join(measured(trusted), F.col(group).eqNullSafe(F.col("_g"))).where(~F.exists("ok", lambda q: (q["lo"] <= F.col(ix)) & (F.col(ix) <= q["hi"])))
    gaps = islands(free.select(F.col(group).alias("grp"), F.col(ix).alias("ix"))).select(F.col("grp").alias(group), F.lit(None).cast(kinds[part].dataType).alias("part"), "first_ix", "last_ix", F.lit("gap").alias("state"))
    return parts.unionByName(gaps)


def anchor_steps(headers: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """producer, file_seq, anchor: the steps at which a run has seen exactly one of the token counts."""
    whole = lambda k: F.col("args")[k].try_cast("bigint")
    d = headers.withColumn("eff", whole("batch") * F.coalesce(whole("accum"), F.lit(1)) * whole("ctx")).where("eff > 0")
    exact = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: t % F.col("eff") == 0)
    return d.select("producer", "file_seq", F.explode(F.transform(exact, lambda t: F.floor(t / F.col("eff")).cast("bigint"))).alias("anchor"))


def largest(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The ``k`` largest distinct values of each group, by ``k`` passes of a plain maximum: no group is sorted or gathered."""
    left, out = rows.select(group, value).distinct(), None
    for _ in range(k):
        top = left.groupBy(group).agg(F.max(value).alias(value))
        out = top if out is None else out.unionByName(top)
        left = left.join(top.select(F.col(group).alias("_g"), F.col(value).alias("_top")), F.col(group).eqNullSafe(F.col("_g"))).where(F.col(value) < F.col("_top")).drop("_g", "_top")
    return out
