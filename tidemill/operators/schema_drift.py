"""One consistent table from files whose fields come, go, change name or type, and the list of those changes.

Rows are loaded as path-value maps that keep each value's raw type (Spark's variant). A first aggregate by file and path gives
how often a path occurs, with which types, and what its values are like (in fixed-width buffers, so it hashes and never sorts); the
statistics of a file then become one row, and everything after it works on these rows, so a producer that wrote a third of all rows
is no more than its number of files. Each file is compared with the one before it, inside one row. A field that leaves and one that comes in the same file are the same quantity if

* their values carry on (numbers: the levels differ by no more than half, or by their scatter; settings: the same value, also
  when it is written as text, wrapped in an object's ``value`` or in a list), and
* the two names are never in one file anywhere in the input (share at most ``MAX_TOGETHER``): different quantities meet
  sooner or later, two names of one quantity do not,

and each is the other's best partner by level, share of nulls, name and number of such pairs in the whole input. The table then
reads every path, settings included, under the most widespread of its names and casts it to the type of most of its values;
failed casts are counted per file.

Defined results: a body that is no JSON object has no fields but still makes its file exist; nulls have no type; a producer's
first file shows no change; lines stored twice count twice in the statistics and change nothing else; a field with nulls only
on either side cannot carry on and so is no rename; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sizes import measured

MAX_TOGETHER = 0.02
TYPES = ("number", "string", "boolean", "array", "object")
COLUMNS = ("step", "train", "avg50", "val", "val_bpb", "lr", "gnorm", "lmax")
_FILE = ["producer", "file_seq"]


def _kind(raw: Column) -> Column:
    return (
        F.when(raw == "VOID", F.lit(None))
        .when(raw == "STRING", "string")
        .when(raw == "BOOLEAN", "boolean")
        .when(raw.startswith("ARRAY"), "array")
        .when(raw.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _unwrapped(value: str, kind: Column) -> Column:
    """The scalar's text: of itself, of an object's ``value``, or of a list's first element."""
    own = F.expr(f"try_variant_get({value}, '$', 'string')")
    first = F.when(kind == "object", F.expr(f"try_variant_get({value}, '$.value', 'string')")).when(kind == "array", F.expr(f"try_variant_get({value}, '$[0]', 'string')"))
    return F.coalesce(first, own)


def path_values(records: DataFrame) -> DataFrame:
    """producer, file_seq, line_no, path, kind, text (of what is no number) and num of every field of every record."""
    parsed = records.select(*_FILE, "line_no", F.expr("try_parse_json(body)").alias("v"))
    header = F.expr("try_variant_get(v, '$.args', 'variant')")
    parsed = parsed.withColumn("is_header", header.isNotNull()).withColumn("fields", F.expr("try_variant_get(CASE WHEN is_header THEN variant_get(v, '$.args', 'variant') ELSE v END, '$', 'map<string,variant>')"))
    flat = parsed.select(*_FILE, "line_no", "is_header", F.explode("fields").alias("key", "value"))
    flat = flat.withColumn("kind", _kind(F.expr("schema_of_variant(value)")))
    flat = flat.select(*_FILE, "line_no", F.when(F.col("is_header"), F.concat(F.lit("args."), F.col("key"))).otherwise(F.col("key")).alias("path"), "kind", "value")
    number = F.coalesce(F.col("kind") == "number", F.lit(False))
    flat = flat.select(*_FILE, "line_no", "path", "kind", F.when(number, F.expr("try_variant_get(value, '$', 'double')")).alias("own"), F.when(~number, _unwrapped("value", F.col("kind"))).alias("text"))
    truth = F.when(F.lower("text") == "true", 1.0).when(F.lower("text") == "false", 0.0)
    return flat.withColumn("num", F.coalesce("own", F.expr("try_cast(text AS double)"), truth)).drop("own")


def path_statistics(values: DataFrame) -> DataFrame:
    """One row per file and path."""
    kinds = F.array_compact(F.array(*[F.when(F.max(F.col("kind") == t), F.lit(t)) for t in sorted(TYPES)]))
    return values.groupBy(*_FILE, "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("kind").alias("filled"),
        kinds.alias("kinds"),
        F.count("num").alias("n_num"),
        F.avg("num").alias("mean"),
        F.coalesce(F.stddev_pop("num"), F.lit(0.0)).alias("scatter"),
        F.min("num").alias("low"),
        F.max("num").alias("high"),
        *[how(F.when(F.col("num").isNull() & F.col("text").isNotNull(), F.xxhash64("text", F.lit(seed)))).alias(f"{name}_text{seed}") for seed in (0, 1) for how, name in ((F.min, "low"), (F.max, "high"))],
    )


def _carries_on(a: Column, b: Column) -> Column:
    setting = a["path"].startswith("args.")
    same = a["low"].eqNullSafe(b["low"])
    for c in ("high", "low_text0", "high_text0", "low_text1", "high_text1"):  # images of texts under two seeds: 128 bits
        same = same & a[c].eqNullSafe(b[c])
    level = (a["n_num"] > 0) & (b["n_num"] > 0) & (F.abs(a["mean"] - b["mean"]) <= F.greatest(0.5 * F.greatest(F.abs(a["mean"]), F.abs(b["mean"])), 4 * (a["scatter"] + b["scatter"])))
    near = level & (F.abs(a["mean"] - b["mean"]) <= 0.9 * F.greatest(F.abs(a["mean"]), F.abs(b["mean"])))
    return (setting == b["path"].startswith("args.")) & (a["filled"] > 0) & (b["filled"] > 0) & F.when(setting, same).otherwise(near)


def _plain(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, "^args\\.", ""), "_", ""))


def _distance(a: Column, b: Column) -> Column:
    """How unlike two fields are: level, share of nulls and name, each between 0 and 1."""
    top = F.greatest(F.abs(a["mean"]), F.abs(b["mean"]))
    level = F.when(top > 0, F.least(F.lit(1.0), F.abs(a["mean"] - b["mean"]) / top)).otherwise(0.0)
    nulls = F.abs(a["filled"] / a["n"] - b["filled"] / b["n"])
    x, y = _plain(a["path"]), _plain(b["path"])
    name = F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.coalesce(level, F.lit(0.0)) + nulls + name


def file_fields(records: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per file: its fields with their statistics (none for a file without objects), and those of the file before it (null
    for a producer's first)."""
    body = F.struct(*[c for c in stats.columns if c not in _FILE])
    mine = stats.select(*_FILE, body.alias("field"))
    # A file of which no record is an object has no statistics; it is counted in by a row without field, dropped again below.
    every = mine.unionByName(records.select(*_FILE, F.lit(None).cast(mine.schema["field"].dataType).alias("field")).distinct())
    files = every.groupBy(*_FILE).agg(F.collect_list("field").alias("fields"))
    return files.withColumn("before", F.lag("fields").over(Window.partitionBy("producer").orderBy("file_seq")))


def compared(files: DataFrame) -> DataFrame:
    """One row per later file: fields gone, fields come, and fields in both files whose types differ (their paths)."""
    paths = lambda c: F.transform(c, lambda f: f["path"])
    both = files.where("before IS NOT NULL").withColumn("old_paths", paths("before")).withColumn("new_paths", paths("fields"))
    kinds = F.map_from_arrays("old_paths", F.transform("before", lambda f: f["kinds"]))
    return both.select(
        *_FILE,
        F.filter("before", lambda f: ~F.array_contains(F.col("new_paths"), f["path"])).alias("gone"),
        F.filter("fields", lambda f: ~F.array_contains(F.col("old_paths"), f["path"])).alias("come"),
        paths(F.filter("fields", lambda f: F.coalesce(_differs(F.try_element_at(kinds, f["path"]), f["kinds"]), F.lit(False)))).alias("retyped"),
    )


def renames(sides: DataFrame, files: DataFrame, max_together: float = MAX_TOGETHER) -> DataFrame:
    """producer, file_seq, field_from, field_to, kinds_from, kinds_to."""
    pairs = sides.select(*_FILE, F.explode("gone").alias("a"), "come").select(*_FILE, "a", F.explode(F.filter("come", lambda b: _carries_on(F.col("a"), b))).alias("b"))
    pairs = cut(pairs.select(*_FILE, F.col("a.path").alias("field_from"), F.col("b.path").alias("field_to"), F.col("a.kinds").alias("kinds_from"), F.col("b.kinds").alias("kinds_to"), _distance(F.col("a"), F.col("b")).alias("distance")))
    names = measured(pairs.groupBy("field_from", "field_to").agg(F.count(F.lit(1)).alias("support")))
    each = files.select(F.transform("fields", lambda f: f["path"]).alias("paths")).select("paths", F.explode("paths").alias("path"))
    met = each.join(names, F.col("path") == F.col("field_from")).where(F.array_contains(F.col("paths"), F.col("field_to"))).groupBy("field_from", "field_to").agg(F.count(F.lit(1)).alias("together"))
    spread = each.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    ends = names.select("*", F.explode(F.array("field_from", "field_to")).alias("path"))
    least = ends.join(spread, "path").groupBy("field_from", "field_to", "support").agg(F.min("n").alias("least"))
    judged = least.join(met, ["field_from", "field_to"], "left").where(F.coalesce("together", F.lit(0)) <= max_together * F.col("least")).select("field_from", "field_to", "support")
    scored = pairs.join(measured(judged), ["field_from", "field_to"]).withColumn("score", F.col("distance") - 0.3 * F.log("support"))
    held = scored.groupBy(*_FILE).agg(F.collect_list(F.struct("score", "field_from", "field_to", "kinds_from", "kinds_to")).alias("ps"))

    def better(p: Column, side: str, other: str) -> Column:
        return F.exists("ps", lambda q: (q[side] == p[side]) & (F.struct(q["score"], q[other]) < F.struct(p["score"], p[other])))

    best = F.filter("ps", lambda p: ~better(p, "field_from", "field_to") & ~better(p, "field_to", "field_from"))
    return held.select(*_FILE, F.explode(best).alias("p")).select(*_FILE, "p.field_from", "p.field_to", "p.kinds_from", "p.kinds_to")


def _differs(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def changes(records: DataFrame) -> DataFrame:
    """producer, file_seq, change_kind, field_from, field_to."""
    files = cut(file_fields(records, path_statistics(path_values(records))))
    sides = compared(files)
    named = renames(sides, files).groupBy(*_FILE).agg(F.collect_list(F.struct("field_from", "field_to", "kinds_from", "kinds_to")).alias("named"))
    keys = named.select(F.col("producer").alias("n_producer"), F.col("file_seq").alias("n_seq"), "named")
    d = sides.join(keys, F.col("producer").eqNullSafe(F.col("n_producer")) & F.col("file_seq").eqNullSafe(F.col("n_seq")), "left")
    d = d.withColumn("named", F.coalesce("named", F.array().cast(keys.schema["named"].dataType)))
    change = lambda kind, a, b: F.struct(F.lit(kind).alias("change_kind"), a.alias("field_from"), b.alias("field_to"))
    nothing = F.lit("")
    gone = F.array_except(F.transform("gone", lambda f: f["path"]), F.transform("named", lambda p: p["field_from"]))
    come = F.array_except(F.transform("come", lambda f: f["path"]), F.transform("named", lambda p: p["field_to"]))
    listed = F.concat(
        F.transform("named", lambda p: change("renamed", p["field_from"], p["field_to"])),
        F.transform(F.filter("named", lambda p: _differs(p["kinds_from"], p["kinds_to"])), lambda p: change("type", p["field_to"], p["field_to"])),
        F.transform(gone, lambda p: change("removed", p, nothing)),
        F.transform(come, lambda p: change("added", nothing, p)),
        F.transform("retyped", lambda p: change("type", p, p)),
    )
    return d.select(*_FILE, F.inline(listed))


def _joined_names(pairs: DataFrame) -> DataFrame:
    """``first_names`` of any number of pairs (field_from, field_to, n): the smallest name of each group spreads along the pairs."""
    pairs = cut(pairs)
    both = pairs.select(F.col("field_from").alias("a"), F.col("field_to").alias("b")).union(pairs.select("field_to", "field_from"))
    labels, moved = cut(both.select(F.col("a").alias("path"), F.col("a").alias("root")).distinct()), 1
    while moved:
        near = both.join(labels, F.col("a") == F.col("path")).groupBy("b").agg(F.min("root").alias("low"))
        step = cut(labels.join(near, F.col("path") == F.col("b")).select("path", "root", F.least("root", "low").alias("low")))
        moved = step.where(F.col("low") < F.col("root")).count()
        ahead = step.select(F.col("path").alias("of"), F.col("low").alias("next"))
        labels = cut(step.join(ahead, F.col("low") == F.col("of")).select("path", F.col("next").alias("root")))
    left = pairs.groupBy(F.col("field_from").alias("of")).agg(F.sum("n").alias("n"))
    best = labels.join(left, F.col("path") == F.col("of"), "left").groupBy("root").agg(F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "path")).alias("best"))
    return labels.join(best, "root").select("path", F.col("best.path").alias("name"))


def first_names(renamed: DataFrame, bound: int = 10_000) -> DataFrame:
    """path, name: every name that ever took part in a rename and the most widespread name of the same quantity.

    The pairs of names are as many as there are spellings, not rows; beyond ``bound`` they are grouped by joins, to the same names.
    """
    counted = renamed.groupBy("field_from", "field_to").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.orderBy(F.desc("n"), "field_from", "field_to").limit(bound + 1).collect()
    spark = renamed.sparkSession
    if len(pairs) > bound:
        return _joined_names(counted)
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    left: dict[str, int] = {}
    for p in pairs:
        left[p.field_from] = left.get(p.field_from, 0) + p.n
        root[find(p.field_to)] = find(p.field_from)
    groups: dict[str, list[str]] = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    rows = [(x, max(g, key=lambda y: (left.get(y, 0), y))) for g in groups.values() for x in g]
    return spark.createDataFrame(rows, "path string, name string")


def _line_values(records: DataFrame) -> DataFrame:
    """producer, file_seq, line_no, path, filled, text, num, whole, truth of every field, those beside a header's ``args`` included.

    Unlike in the statistics, a list of several elements and an object with more than its ``value`` keep their whole text.
    """
    parsed = records.select(*_FILE, "line_no", F.expr("try_parse_json(body)").alias("v"))
    top, args = F.expr("try_variant_get(v, '$', 'map<string,variant>')"), F.expr("try_variant_get(v, '$.args', 'map<string,variant>')")
    settings = F.transform(F.map_entries(args), lambda e: F.struct(F.concat(F.lit("args."), e["key"]).alias("key"), e["value"].alias("value")))
    own = F.when(args.isNull(), F.map_entries(top)).otherwise(F.filter(F.map_entries(top), lambda e: e["key"] != "args"))
    flat = parsed.select(*_FILE, "line_no", F.inline(F.when(args.isNull(), own).otherwise(F.concat(settings, own))).alias("path", "value"))
    several = F.expr("try_variant_get(value, '$[1]', 'variant') IS NOT NULL OR coalesce(size(try_variant_get(value, '$', 'map<string,variant>')), 0) > 1")
    flat = flat.withColumn("kind", _kind(F.expr("schema_of_variant(value)")))
    flat = flat.select(*_FILE, "line_no", "path", F.col("kind").isNotNull().alias("filled"), F.when(several, F.expr("to_json(value)")).otherwise(_unwrapped("value", F.col("kind"))).alias("text"))
    truth = F.when(F.lower("text") == "true", True).when(F.lower("text") == "false", False)
    flat = flat.withColumn("truth", truth).withColumn("whole", F.expr("try_cast(text AS bigint)"))
    return flat.withColumn("num", F.coalesce(F.expr("try_cast(text AS double)"), F.col("truth").cast("double")))


def _named_values(records: DataFrame) -> DataFrame:
    files = cut(file_fields(records, path_statistics(path_values(records))))
    names = first_names(renames(compared(files), files))
    return _line_values(records).join(measured(names), "path", "left").withColumn("name", F.coalesce("name", "path"))


def _field_types(values: DataFrame, columns: tuple[str, ...]) -> dict[str, str]:
    """The type that most filled values of each name have; ``columns`` come first and are doubles. As many as names, not rows."""
    counts = values.groupBy("name").agg(F.count_if("filled").alias("n"), F.count("num").alias("n_num"), F.count("truth").alias("n_truth"), F.count("whole").alias("n_whole")).orderBy("name")
    types = dict.fromkeys(columns, "double")
    for r in counts.collect():
        kind = "string"
        if 2 * r.n_truth > r.n:
            kind = "boolean"
        elif 2 * r.n_num > r.n:
            kind = "bigint" if r.n_whole == r.n_num else "double"
        types.setdefault(r.name, kind)
    return types


def _cast(kind: str) -> Column:
    as_truth = F.when(F.col("num").isin(0.0, 1.0), F.col("num") == 1.0)
    return {"double": F.col("num"), "bigint": F.col("whole"), "boolean": as_truth, "string": F.col("text")}[kind]


def _free_names(names: list[str]) -> list[str]:
    """Column names that differ from the keys and, whatever their case, from each other."""
    taken, out = {*_FILE, "line_no"}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_table(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """All fields and settings (``args.x``) of all files as one typed table, one row per (producer, file, line).

    ``columns`` are always there, as doubles; every other name of the input follows with the type of most of its values. A name
    that is taken but for its case gets an underscore. If a line has two values of one name, the larger one is kept.
    """
    values = _named_values(records)
    types = _field_types(values, columns)
    picked = [F.max(F.when(F.col("filled") & (F.col("name") == c), _cast(kind))).alias(free) for (c, kind), free in zip(types.items(), _free_names(list(types)))]
    return values.groupBy(*_FILE, "line_no").agg(*picked)


def failed_casts(records: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Per file and name, settings included: filled values and those that ``one_table`` cannot read with the name's type."""
    values = _named_values(records)
    types = _field_types(values, columns)
    fits = F.lit(False)
    for kind in ("double", "bigint", "boolean", "string"):
        fits = fits | (F.col("name").isin([c for c, k in types.items() if k == kind]) & _cast(kind).isNotNull())
    return values.groupBy(*_FILE, "name").agg(F.count_if("filled").alias("filled"), F.count_if(F.col("filled") & ~fits).alias("failed"), F.countDistinct("path").alias("spellings"))
