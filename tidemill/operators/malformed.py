"""Load delimited and JSON lines; set the lines that cannot be read aside with the reason.

Steps: (1) each delimited file's first line is looked up per file (a salted join, so a file that holds a third of all lines
is spread over tasks); (2) the quote-aware ``Assembler`` decides where a record ends. A record may span as many physical lines
as it is allowed to: one line here (each line has an id of its own), so a quote that is still open at the end of a line is the
assembler's finding, any number for raw text sources (``assemble``); (3) Python's strict csv reader, or a strict JSON reader,
parses each record inside Arrow batches, and whatever exception it raises becomes the reason; (4) only then typed field
constructors run, whose exceptions are reasons, too. So no line can stop the job.

Defined results: a null line is a blank line; a carriage return at the end belongs to the line end; blank lines are neither
rows nor failures; the line with the smallest number in a delimited file (ties: smallest id) is its header and no row; a file
whose header lacks a required column fails line by line; an unknown format fails; an empty table gives an empty result;
further columns, whatever their names, are ignored. A number too large for its column is a valid number: the column is null
and ``fields`` has all its digits (in delimited files a train value beyond the doubles is not finite, so it fails). A lone
surrogate in a JSON text is written as its escape. JSON that is nested more deeply than the reader allows fails.
"""

from __future__ import annotations

import csv
import json
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
DELIMITERS = {"csv": ",", "tsv": "\t"}
TYPED = ("step", "train", "avg50", "val", "val_bpb", "lr", "gnorm")
TEXT_COLUMNS = ("note",)
#: Objects with one of these keys are marker rows and need a step only.
MARKERS = ("throughput", "chunk_complete", "early_stop")

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_DIGITS = re.compile(r"[0-9]+")
_JSON_NUMBER = re.compile(r"(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?")
_CR, _LF = "\ue000", "\ue001"  # stand for line ends inside a field while csv reads the record
_SCHEMA = "line_id bigint, file_name string, line_no int, ok boolean, reason string, kind string, step bigint, train double, fields map<string,string>"


class Unreadable(ValueError):
    """The reason why a line is no row."""


class Assembler:
    """Joins physical lines into records: a record goes on while its quotes are unbalanced, for at most ``span`` lines (None: any)."""

    def __init__(self, span: int | None = None, quote: str = '"') -> None:
        self.span, self.quote = span, quote
        self.held: list[str] = []
        self.open = False

    def feed(self, line: str) -> tuple[str, bool] | None:
        """The record that ends with this line and whether a quote is still open in it; None while the record goes on."""
        self.held.append(line)
        self.open ^= line.count(self.quote) % 2 == 1
        if self.open and (self.span is None or len(self.held) < self.span):
            return None
        return self.finish()

    def finish(self) -> tuple[str, bool] | None:
        """What is held at the end of the input."""
        if not self.held:
            return None
        record, left_open = "\n".join(self.held), self.open
        self.held, self.open = [], False
        return record, left_open


def assemble(lines: Iterable[str], span: int | None = None) -> Iterator[tuple[str, bool]]:
    """Records of a raw text source, each with whether a quote is still open at its end."""
    assembler = Assembler(span)
    for line in lines:
        record = assembler.feed(line)
        if record is not None:
            yield record
    last = assembler.finish()
    if last is not None:
        yield last


def _bare_quote(record: str, delimiter: str) -> bool:
    d = re.escape(delimiter)
    return re.fullmatch(rf'(?:"(?:[^"]|"")*"|[^"{d}][^"{d}]*|)(?:{d}(?:"(?:[^"]|"")*"|[^"{d}][^"{d}]*|))*', record, re.S) is None


def split_record(record: str, delimiter: str) -> list[tuple[str, bool]]:
    """Fields of one record with whether each was quoted; raises Unreadable on broken structure."""
    try:
        fields = next(csv.reader([record.replace("\r", _CR).replace("\n", _LF)], delimiter=delimiter, strict=True), [])
    except csv.Error as e:
        raise Unreadable("unclosed quote" if "end of data" in str(e) else f"broken quoting: {e}") from None
    if _bare_quote(record, delimiter):
        raise Unreadable("quote inside an unquoted field")
    out, at = [], 0
    for f in fields or [""]:
        quoted = record.startswith('"', at)
        at += len(f) + 1 + (2 + f.count('"') if quoted else 0)
        f = f.replace(_CR, "\r").replace(_LF, "\n")
        out.append((f if quoted else f.strip(" \t\r\n\f\v"), quoted))
    return out


def _bigint(digits: str) -> int | None:
    """A whole number that the step column holds; None if it is larger (its digits stay in ``fields``)."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) < 19 or (len(digits) == 19 and digits <= "9223372036854775807") else None


def _finite(text: str) -> float | None:
    value = float(text)
    return value if math.isfinite(value) else None


def _number(text: str, name: str) -> float:
    if not _NUMBER.fullmatch(text):
        raise Unreadable(f"{name}: not a number")
    value = _finite(text)
    if value is None:
        raise Unreadable(f"{name}: not finite")
    return value


def _step(text: str) -> int | None:
    if not _DIGITS.fullmatch(text):
        raise Unreadable("step: not ASCII digits")
    return _bigint(text)


def read_delimited(record: str, header: str | None, delimiter: str) -> tuple[str, int | None, float, dict]:
    if header is None:
        raise Unreadable("no header line")
    names = [n for n, _ in split_record(header, delimiter)]
    if "step" not in names or "train" not in names:
        raise Unreadable("header lacks step or train")
    fields = split_record(record, delimiter)
    if len(fields) != len(names):
        raise Unreadable("too few fields" if len(fields) < len(names) else "too many fields")
    row = dict(zip(reversed(names), (v for v, _ in reversed(fields))))
    step, train = _step(row["step"]), _number(row["train"], "train")
    for name, value in row.items():
        if value and name not in ("step", "train", *TEXT_COLUMNS):
            _number(value, name)
    return "step", step, train, row


class _Number(str):
    """A JSON number as it is written: no digit is lost, however many there are."""


def _no_constant(text: str):
    raise Unreadable(f"json: {text} is no JSON value")


def _whole(number: str) -> tuple[bool, int | None]:
    """Whether a JSON number is whole and not below zero, and its value if the step column holds it."""
    sign, digits, fraction, exponent = _JSON_NUMBER.fullmatch(number).groups()
    fraction = fraction or ""
    digits, places = digits + fraction, len(fraction)
    if not digits.strip("0"):
        return True, 0
    power = exponent or "0"
    far = len(power.lstrip("+-0")) > 9  # shifts every digit to one side
    shift = (-1 if power.startswith("-") else 1) * 10**9 if far else int(power)
    shift -= places
    if shift < 0 and (-shift > len(digits) or digits[shift:].strip("0")):
        raise Unreadable("step: not a whole number")
    if sign:
        raise Unreadable("step: negative")
    if shift > 19:
        return True, None
    return True, _bigint(digits[:shift] if shift < 0 else digits + "0" * shift)


def _as_text(value: object) -> str | None:
    """A field as text: strings as they are, other values as JSON with numbers as written. No recursion, so any depth will do."""
    if value is None or isinstance(value, str):
        return value
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        literal, v = todo.pop()
        if literal or isinstance(v, _Number):
            out.append(v)
        elif isinstance(v, dict):
            parts: list[tuple[bool, object]] = [(True, "{")]
            for i, (k, x) in enumerate(v.items()):
                parts += [(True, (", " if i else "") + json.dumps(k) + ": "), (False, x)]
            todo += reversed([*parts, (True, "}")])
        elif isinstance(v, list):
            parts = [(True, "[")]
            for i, x in enumerate(v):
                parts += [(True, ", "), (False, x)] if i else [(False, x)]
            todo += reversed([*parts, (True, "]")])
        else:
            out.append(json.dumps(v))
    return "".join(out)


def read_json(record: str) -> tuple[str, int | None, float | None, dict]:
    try:
        value = json.loads(record, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)
    except json.JSONDecodeError as e:
        raise Unreadable(f"json: {e.msg}") from None
    except RecursionError:
        raise Unreadable("json: nested too deeply") from None
    if not isinstance(value, dict):
        raise Unreadable("json: not an object")
    fields = {k: _as_text(v) for k, v in value.items()}
    if "args" in value:
        return "header", None, None, fields
    step, train = value.get("step"), value.get("train")
    if not isinstance(step, _Number):
        raise Unreadable("step: not a whole number")
    _, whole = _whole(step)
    marker = next((m for m in MARKERS if m in value), None)
    if marker is None and not isinstance(train, _Number):
        raise Unreadable("train: not a number")
    return marker or "step", whole, _finite(train) if isinstance(train, _Number) else None, fields


def read_line(line: str, file_format: str | None, header: str | None) -> tuple[str, int | None, float | None, dict]:
    """One physical line as a record of one line."""
    if line.endswith("\r"):
        line = line[:-1]
    if file_format == "jsonl":
        return read_json(line)
    if file_format not in DELIMITERS:
        raise Unreadable("unknown format")
    record, left_open = next(assemble([line], span=1))
    if left_open:
        raise Unreadable("unclosed quote")
    return read_delimited(record, header[:-1] if header is not None and header.endswith("\r") else header, DELIMITERS[file_format])


def _clean(text: str | None) -> str | None:
    """Text that can be written as UTF-8: lone surrogates become their escapes."""
    return text if text is None or text.isascii() else text.encode("utf-8", "backslashreplace").decode("utf-8")


def judge(line: str, file_format: str | None, header: str | None) -> tuple:
    """ok, reason, kind, step, train, fields of one line; never raises."""
    try:
        kind, step, train, fields = read_line(line, file_format, header)
        return True, None, kind, step, train, [(_clean(k), _clean(v)) for k, v in fields.items()]
    except Unreadable as e:
        reason = str(e)
    except Exception as e:  # noqa: BLE001 - whatever a reader or constructor raises is a finding about the line
        reason = f"{type(e).__name__}: {e}"
    return False, _clean(reason), None, None, None, None


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("line_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("ok", pa.bool_()), ("reason", pa.string()), ("kind", pa.string())]
    schema = pa.schema([*kinds, ("step", pa.int64()), ("train", pa.float64()), ("fields", pa.map_(pa.string(), pa.string()))])
    csv.field_size_limit(1 << 30)
    for batch in batches:
        out: dict[str, list] = {n: [] for n in schema.names}
        for line_id, file_name, line_no, file_format, line, header in zip(*(batch.column(c).to_pylist() for c in ("line_id", "file_name", "line_no", "file_format", "line", "header"))):
            if line is None or not line.strip():
                continue
            for name, value in zip(schema.names, (line_id, file_name, line_no, *judge(line, file_format, header))):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def parse_lines(lines: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every line that is neither blank nor a header, read or with the reason why not."""
    rows = lines.select("line_id", "file_name", "line_no", "file_format", "line")
    delimited = F.coalesce(F.col("file_format").isin(*DELIMITERS), F.lit(False))
    heads = (
        rows.where(delimited)
        .groupBy("file_name")
        .agg(F.min(F.struct("line_no", "line_id", "line")).alias("head"))
        .select(F.col("file_name").alias("of_file"), "head", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("of_salt"))
    )
    table = rows.where(delimited).withColumn("salt", F.pmod(F.xxhash64("line_id"), F.lit(salts)).cast("int"))
    joined = table.join(heads, F.col("file_name").eqNullSafe(F.col("of_file")) & (F.col("salt") == F.col("of_salt")), "left")
    columns = ["line_id", "file_name", "line_no", "file_format", "line"]
    with_head = joined.where(~F.col("line_id").eqNullSafe(F.col("head.line_id"))).select(*columns, F.col("head.line").alias("header"))
    free = rows.where(~delimited).select(*columns, F.lit(None).cast("string").alias("header"))
    return with_head.unionByName(free).mapInArrow(_batches, _SCHEMA)


def failed_lines(lines: DataFrame) -> DataFrame:
    return parse_lines(lines).where(~F.col("ok")).select("line_id", "reason")


def loaded_rows(lines: DataFrame) -> DataFrame:
    """The valid rows with typed columns; ``fields`` has every field as text, those of other names included."""
    typed = [F.expr(f"try_cast(fields['{c}'] AS double)").alias(c) for c in TYPED[2:]]
    return parse_lines(lines).where("ok").select("line_id", "file_name", "line_no", "kind", "step", "train", *typed, F.col("fields")["note"].alias("note"), "fields")
