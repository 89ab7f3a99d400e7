import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.operators import malformed as m

HEAD = "step,train,gnorm,note"


def reason(line, form="csv", header=HEAD):
    try:
        m.read_line(line, form, header)
    except m.Unreadable as e:
        return str(e)
    return None


@pytest.mark.parametrize(
    "line",
    ["1,2.5,,", "1,2.5,0.1,a note", '1,"2.5",0.1,"a, b"', ' 7 , 2.5e-1 ,.5,"say ""x"""', "1,+2.,,ok\r", '"12",3,,', "1,2,3,a\rb", "1,2,3,步", '1,2,3,""'],
)
def test_good_csv(line):
    assert reason(line) is None


@pytest.mark.parametrize(
    "line",
    ["1,2.5,", "1,2.5,,x,y", '1,2.5,,"open', '1,2.5,,a"b', '1,2.5,,"a"b', "1,NaN,,", "1,inf,,", "1,1e999,,", "1.0,2,,", "-1,2,,", ",2,,", "1,,,", "1,2,x,", "١,2,,", "1e3,2,,", '1," 2",,', '1,2,, "x"'],
)
def test_bad_csv(line):
    assert reason(line) is not None


@pytest.mark.parametrize("line", ['{"step": 1, "train": 2}', ' {"step":0,"train":1e3}\r', '{"args": {}}', '{"step": 3, "throughput": true}', '{"step": 2.0, "train": 1.5, "early_stop": null}', '{"step":1,"train":2,"x":"\\u0041"}'])
def test_good_json(line):
    assert reason(line, "jsonl") is None


@pytest.mark.parametrize(
    "line",
    ["{}", "[1]", "null", '{"step": "1", "train": 2}', '{"step": 1.5, "train": 2}', '{"step": -1, "train": 2}', '{"step": true, "train": 2}', '{"step": 1, "train": true}', '{"step": 1, "train": NaN}', '{"step": 1}',
     '{"step": 1, "train": 2,}', "{'step': 1}", '{"step": 1, "train": 2} x', '{"step": 1, "train": "2"}', '{"step": 1, "train": 2, "n": "a\tb"}', "[" * 100000, '{"throughput": 1}'],
)
def test_bad_json(line):
    assert reason(line, "jsonl") is not None


def test_tsv_header_and_formats():
    assert reason("5\tx, y\t1.5", "tsv", "step\tnote\ttrain") is None
    assert reason("1,2", "csv", "a,b") == "header lacks step or train"
    assert reason("1,2", "csv", None) == "no header line"
    assert reason("1,2", None) == "unknown format"


def test_assemble_joins_open_quotes():
    assert list(m.assemble(["a,b", '1,"x', 'y"', "2,z"])) == [("a,b", False), ('1,"x\ny"', False), ("2,z", False)]
    assert list(m.assemble(['1,"x', "y"])) == [('1,"x\ny', True)] and list(m.assemble([])) == []
    assert list(m.assemble(['1,"x', 'y"', "z"], span=1)) == [('1,"x', True), ('y"', True), ("z", False)]


HUGE = ['{"step":1,"train":' + "9" * 401 + "}", '{"step":' + "7" * 5000 + ',"train":2}', '{"step":1,"train":' + "9" * 4500 + "}", '{"step":1e99999999999999999999,"train":-1E400}', '{"step":9223372036854775808,"train":1}']


def test_no_number_is_too_large(spark):
    for line in HUGE:
        assert reason(line, "jsonl") is None
    assert reason("9" * 5000 + ",2.5,,") is None and reason("1," + "9" * 500 + ",,") == "train: not finite"
    assert reason('{"step":1e-400,"train":1}', "jsonl") == reason('{"step":10e-2,"train":1}', "jsonl") == "step: not a whole number"
    assert reason('{"step":-0.0,"train":1}', "jsonl") is None and reason('{"step":-1e99,"train":1}', "jsonl") == "step: negative"
    assert m.read_json('{"step":1200e-2,"train":1}')[1] == 12 and m.read_json('{"step":1.2e3,"train":1}')[1] == 1200
    lines = [*HUGE, '{"step":2,"train":1,"note":"\\ud800 x"}', '{"step":3,"train":1,"n":' + "[" * 500 + "1.50" + "]" * 500 + "}"]
    df = spark.createDataFrame([(i, "g", i, "jsonl", x) for i, x in enumerate(lines)], "line_id bigint, file_name string, line_no int, file_format string, line string")
    rows = {r.line_id: r for r in m.loaded_rows(df).collect()}
    assert sorted(rows) == list(range(7)) and m.failed_lines(df).count() == 0
    assert rows[0].train is None and rows[0].fields["train"] == "9" * 401 and rows[1].step is None and rows[1].fields["step"] == "7" * 5000 and rows[4].step is None
    assert rows[5].note == "\\ud800 x" and rows[6].fields["n"] == "[" * 500 + "1.50" + "]" * 500


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.binary(max_size=40).map(lambda b: b.decode("utf-8", "surrogateescape")), st.text(alphabet='{}[]",:step train0123456789eE.-+\\u\r\n\x00', max_size=60)), st.sampled_from(["csv", "tsv", "jsonl", None, "x"]), st.sampled_from([HEAD, HEAD + "\r", "step\ttrain", None, '"', ""]))
def test_no_line_stops_the_job(line, form, header):
    ok, why, kind, *_ = got = m.judge(line, form, header)
    assert ok == (why is None) == (kind is not None)
    m.pa.array([x for x in got if isinstance(x, str)], m.pa.string())


def test_frame(spark):
    big = "9" * 10 + "," + "1" * 5 + ",," + "x" * 300_000
    rows = [
        (1, "f.csv", 1, "csv", HEAD), (2, "f.csv", 2, "csv", "1,2.5,0.5,n"), (3, "f.csv", 3, "csv", "bad"), (4, "f.csv", 4, "csv", " "), (5, "f.csv", 5, "csv", None), (6, "f.csv", 6, "csv", "\r"),
        (7, "g.jsonl", 1, "jsonl", '{"args": {"a": 1}}'), (8, "g.jsonl", 2, "jsonl", '{"step": 4, "train": 1.5, "note": "k"}'), (9, None, 1, "csv", HEAD), (10, None, 2, "csv", "1,2,,"), (11, "h", 1, None, "x"),
        (12, "f.csv", 7, "csv", big), (13, "f.csv", 1, "csv", HEAD),
    ]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, file_format string, line string").selectExpr("*", "1 AS header", "2 AS salt", "3 AS ok")
    assert sorted(r.line_id for r in m.failed_lines(df).collect()) == [3, 11, 13]
    loaded = {r.line_id: r for r in m.loaded_rows(df).collect()}
    assert sorted(loaded) == [2, 7, 8, 10, 12]
    assert loaded[2].gnorm == 0.5 and loaded[2].note == "n" and loaded[8].step == 4 and loaded[7].kind == "header" and len(loaded[12].note) == 300_000
    assert m.failed_lines(df.limit(0)).count() == 0


def test_loaded_rows_keep_fields_of_other_names(spark):
    rows = [
        (1, "g.jsonl", 1, "jsonl", '{"args": {"a": [1, 2]}, "params_m": 3.5, "unit": "tok"}'), (2, "g.jsonl", 2, "jsonl", '{"step": 4, "throughput": true, "tok_per_sec": 9.5, "tag": null}'),
        (3, "f.csv", 1, "csv", "step,train,lstd"), (4, "f.csv", 2, "csv", "1,2.5,0.25"),
    ]
    df = spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, file_format string, line string")
    loaded = {r.line_id: r.fields for r in m.loaded_rows(df).collect()}
    assert loaded[1] == {"args": '{"a": [1, 2]}', "params_m": "3.5", "unit": "tok"}
    assert loaded[2] == {"step": "4", "throughput": "true", "tok_per_sec": "9.5", "tag": None} and loaded[4] == {"step": "1", "train": "2.5", "lstd": "0.25"}
