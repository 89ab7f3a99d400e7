import json

from tidemill.operators import schema_drift as s

SCHEMA = "rec_id bigint, producer string, file_seq int, file_name string, line_no int, body string, path string"


def build(spark, files, producer="p"):
    """files: {seq: (args, [step rows])}"""
    rows, rec = [], 0
    for seq, (args, steps) in files.items():
        for n, body in enumerate([{"args": args}, *steps]):
            rec += 1
            rows.append((rec, producer, seq, f"{producer}/{seq}", n + 1, json.dumps(body), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.producer, r.file_seq, r.change_kind, r.field_from, r.field_to) for r in s.changes(df).collect()}


def steps(**fields):
    return [{"step": 10 * i, **{k: v[i % len(v)] for k, v in fields.items()}} for i in range(8)]


G, B, L = [1.5, 1.7, 1.6, 1.4], [None, 1.31, None, None], [236.0, 240.0]


def test_kinds_of_change(spark):
    files = {
        1: ({"lr": 1, "use_rope": True, "ctx": 512}, steps(gnorm=G, val_bpb=B)),
        2: ({"lr": 1, "rope": "true", "ctx": 512}, steps(grad_norm=[str(x) for x in G], val_bpb=B, lstd=L)),
        4: ({"lr": [1], "rope": "true", "seq_len": {"value": 512}}, steps(grad_norm=[str(x) for x in G], val_bpb=[None], lstd=L)),
        5: ({"lr": [1], "rope": "true", "seq_len": {"value": 512}}, steps(grad_norm=[str(x) for x in G], val_bpb=["1.2"])),
    }
    assert found(build(spark, files)) == {
        ("p", 2, "renamed", "gnorm", "grad_norm"), ("p", 2, "type", "grad_norm", "grad_norm"), ("p", 2, "renamed", "args.use_rope", "args.rope"), ("p", 2, "type", "args.rope", "args.rope"), ("p", 2, "added", "", "lstd"),
        ("p", 4, "type", "args.lr", "args.lr"), ("p", 4, "renamed", "args.ctx", "args.seq_len"), ("p", 4, "type", "args.seq_len", "args.seq_len"),
        ("p", 5, "removed", "lstd", ""),
    }


def test_fields_that_meet_elsewhere_are_no_rename(spark):
    swap = {1: ({}, steps(gnorm=G)), 2: ({}, steps(loss=[1.55]))}
    meet = {1: ({}, steps(gnorm=G, loss=[1.5]))}
    assert ("p", 2, "renamed", "gnorm", "loss") in found(build(spark, swap))
    both = build(spark, swap).unionByName(build(spark, meet, "q"))
    assert found(both) == {("p", 2, "removed", "gnorm", ""), ("p", 2, "added", "", "loss")}


def test_values_that_do_not_carry_on(spark):
    files = {1: ({"seed": 7}, steps(gnorm=G)), 2: ({"tok": 9}, steps(wall=[900.0]))}
    assert {k[2] for k in found(build(spark, files))} == {"added", "removed"}


def test_broken_null_and_empty(spark):
    df = build(spark, {1: ({}, steps(a=[1.0])), 2: ({}, steps(a=[1.0]))})
    odd = spark.createDataFrame([(90, "p", 3, "f", 1, "not json", "x"), (91, "p", 4, "f", 1, None, "x"), (92, None, 1, "f", 2, '{"step":1}', "x"), (93, "p", 5, "f", 2, '{"step":1,"a":null}', "x")], SCHEMA)
    got = found(df.unionByName(odd))
    assert got == {("p", 3, "removed", "step", ""), ("p", 3, "removed", "a", ""), ("p", 5, "added", "", "step"), ("p", 5, "added", "", "a")}
    assert found(df.limit(0)) == set()


def test_lines_stored_twice_change_nothing(spark):
    df = build(spark, {1: ({}, steps(gnorm=G)), 2: ({}, steps(g_norm=G))})
    assert found(df.unionByName(df)) == found(df)


def test_one_table_reads_renamed_and_wrapped_values(spark):
    files = {1: ({}, steps(gnorm=G)), 2: ({}, steps(grad_norm=[{"value": x} for x in G])), 3: ({}, steps(grad_norm=["x", "1.5"]))}
    df = build(spark, files)
    rows = s.one_table(df).where("step IS NOT NULL").collect()
    assert len(rows) == 24 and sum(r.gnorm is None for r in rows) == 4
    cast = {(r.file_seq, r.name): (r.filled, r.failed) for r in s.failed_casts(df).collect()}
    assert cast[(3, "gnorm")] == (8, 4) and cast[(2, "gnorm")] == (8, 0)


def test_one_table_keeps_settings_and_every_step_field(spark):
    odd = {"lr": 0.1, "use_rope": True, "seed": 9007199254740993, "tags": ["a", "b"], "corpus": "c.bin", "extra": {"value": 1, "unit": "x"}}
    files = {1: (odd, steps(gnorm=G, wall_s=[900.5], Wall_s=[1], producer=["me"])), 2: ({**odd, "use_rope": "false", "lr": "high"}, steps(gnorm=G, wall_s=["x", 901.5]))}
    df = build(spark, files)
    header = spark.createDataFrame([(99, "q", 1, "f", 1, '{"args": {"lr": [0.2]}, "unit": "tok"}', "x"), (98, "q", 1, "f", 2, '{"args": 3}', "x")], SCHEMA)
    df = df.unionByName(header)
    table = s.one_table(df)
    kinds = dict(table.dtypes)
    assert [kinds[c] for c in ("args.lr", "args.seed", "args.use_rope", "args.tags", "wall_s_", "Wall_s", "producer_")] == ["double", "bigint", "boolean", "string", "double", "bigint", "string"]
    rows = {(r.producer, r.file_seq, r.line_no): r.asDict() for r in table.collect()}
    assert len(rows) == 20
    first, second = rows[("p", 1, 1)], rows[("p", 2, 1)]
    assert (first["args.lr"], first["args.seed"], first["args.use_rope"], first["args.tags"], first["args.corpus"]) == (0.1, 9007199254740993, True, '["a","b"]', "c.bin")
    assert json.loads(first["args.extra"]) == {"value": 1, "unit": "x"}
    assert second["args.lr"] is None and second["args.use_rope"] is False
    assert rows[("q", 1, 1)]["args.lr"] == 0.2 and rows[("q", 1, 1)]["unit"] == "tok" and rows[("q", 1, 2)]["args"] == 3
    assert rows[("p", 1, 2)]["wall_s_"] == 900.5 and rows[("p", 1, 2)]["Wall_s"] == 1 and rows[("p", 1, 2)]["producer_"] == "me"
    cast = {(r.producer, r.file_seq, r.name): (r.filled, r.failed) for r in s.failed_casts(df).collect()}
    assert cast[("p", 2, "args.lr")] == (1, 1) and cast[("p", 1, "args.lr")] == (1, 0)
    assert cast[("p", 2, "wall_s")] == (8, 4) and cast[("p", 1, "args.tags")] == (1, 0)


def test_names_beyond_the_bound_are_the_same(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
    pairs = chain + [("gnorm", "grad_norm"), ("gnorm", "g_norm"), ("grad_norm", "g_norm"), ("gradNorm", "gnorm"), ("gnorm", "gnorm2")] + [("b", "a"), ("b", "a"), ("a", "b")]
    renamed = spark.createDataFrame(pairs, "field_from string, field_to string")
    named = lambda bound: sorted(map(tuple, s.first_names(renamed, bound).collect()))
    assert named(3) == named(10_000) and len(named(3)) == 28 and dict(named(3))["gradNorm"] == "gnorm"
