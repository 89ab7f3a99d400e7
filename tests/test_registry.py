from pyspark.sql import functions as F

from tidemill.operators import registry as g

SCHEMA = "arm string, args map<string,string>, control_args map<string,string>, claimed array<string>, inert array<string>, accepted boolean"


def test_normal_args_and_levers(spark):
    base = {"batch": "8", "accum": "4", "lr": "1", "tokenizer": "tok/a.json", "tok_cache": "x.bin", "seed": "1"}
    rows = [
        ("same", {**base, "batch": "16", "accum": "2", "seed": "9", "tok_cache": "y"}, base, ["lr"], [], False),
        ("two", {**base, "lr": "2", "batch": "16"}, base, ["lr"], [], False),
        ("ok", {**base, "lr": "2"}, base, ["lr"], [], False),
        ("noop", {**base, "lr": "2", "ctx": "5"}, base, ["lr", "ctx"], ["ctx"], None),
        ("code", {**base, "lr": "2", "ctx": "5"}, base, ["lr", "ctx", "code"], [], False),
        ("none", {}, base, ["batch"], [], True),
    ]
    got = {r.arm: r for r in g.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["same"].touched == [] and got["same"].unchanged == ["lr"] and not got["same"].confounded
    assert got["two"].touched == ["eff_batch", "lr"] and got["two"].undeclared == ["eff_batch"] and got["two"].confounded
    assert got["ok"].undeclared == [] and not got["ok"].confounded
    assert not got["noop"].confounded and not got["code"].confounded
    assert got["none"].touched == ["eff_batch", "lr", "vocab"] and not got["none"].confounded


def test_retention(spark):
    rows = [("f", s, "step", 1, False) for s in (1000, 2000, 5000, 6000, 7000, 8000)] + [("f", None, "best", 1, False), ("f", 1500, "step", 1, True)]
    df = spark.createDataFrame(rows, "family string, step bigint, kind string, n_bytes bigint, keeper boolean")
    assert {r.step for r in g.retention(df, 2, 5000).where("keep").collect()} == {5000, 7000, 8000, None, 1500}


def test_islands_and_prefix(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 1, 2, 4, 5, 6, 8, 9)] + [("b", 3)], "grp string, ix int")
    got = sorted((r.grp, r.first_ix, r.last_ix) for r in g.islands(df).collect())
    assert got == [("a", 0, 2), ("a", 4, 6), ("a", 8, 9), ("b", 3, 3)]
    assert sorted((r.first_ix, r.last_ix) for r in g.islands(df.where("grp = 'a'"), 2).collect()) == [(0, 1), (2, 2), (4, 5), (6, 6), (8, 9)]
    kept = g.longest_prefix(df, ~F.col("ix").isin(4, 8)).where("grp = 'a'").collect()
    assert sorted(r.ix for r in kept) == [0, 1, 2]


def scan(spark, parts):
    rows = [("o", p, i) for p, ixs in parts.items() for i in ixs]
    got = g.scanned_parts(spark.createDataFrame(rows, "grp string, part string, ix bigint"), "grp", "part", "ix").collect()
    return sorted((r.part or "", r.state, r.first_ix, r.last_ix) for r in got)


def test_parts_gaps_scrambled_and_overlapping(spark):
    all_ten = range(10)
    got = scan(spark, {"p01": [0, 1, 2], "p03": [4, 5, 6], "p05": [8, 9], "zz": all_ten})
    assert got == [("", "gap", 3, 3), ("", "gap", 7, 7), ("p01", "trusted", 0, 2), ("p03", "trusted", 4, 6), ("p05", "trusted", 8, 9), ("zz", "overlapping", 0, 9)]
    assert scan(spark, {"p0": [0, 3]}) == [("", "gap", 0, 0), ("", "gap", 3, 3), ("p0", "scrambled", 0, 3)]
    assert scan(spark, {"p0": [0, 1], "p1": [1, 2]}) == [("", "gap", 2, 2), ("p0", "trusted", 0, 1), ("p1", "overlapping", 1, 2)]


def test_reconcile(spark):
    rows = [("equal", i, 10, 10) for i in range(3)] + [("trim", 0, 10, 15)] + [("shrink", i, c, h) for i, (c, h) in enumerate([(10, 10), (10, 5), (10, 10), (1, 1)])]
    got = {r.g: (r.state, r.records, r.kept) for r in g.reconciled(spark.createDataFrame(rows, "g string, o bigint, c bigint, h bigint"), "g", "o", "c", "h").collect()}
    assert got == {"equal": ("equal", 3, 30), "trim": ("trim", 1, 10), "shrink": ("shrink", 2, 20)}


def test_anchor_steps(spark):
    h = spark.createDataFrame([("a", 1, {"batch": "8", "accum": "32", "ctx": "512"}), ("b", 1, {"batch": "7", "ctx": "512"}), ("c", 1, {"batch": "x", "ctx": "512"}), ("d", 1, {})], "producer string, file_seq int, args map<string,string>")
    got = {(r.producer, r.anchor) for r in g.anchor_steps(h, (2_097_152_000, 4_194_304_000)).collect()}
    assert got == {("a", 16000), ("a", 32000)}


def test_largest(spark):
    rows = spark.createDataFrame([(g, v) for g in ("a", None) for v in (5, 5, 3, 9, 1)] + [("b", 2)], "g string, v bigint")
    got = sorted((r.g or "", r.v) for r in g.largest(rows, "g", "v", 3).collect())
    assert got == [("", 3), ("", 5), ("", 9), ("a", 3), ("a", 5), ("a", 9), ("b", 2)]
