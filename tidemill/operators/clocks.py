"""Timestamps written in many forms and zones, turned into one moment in UTC, or none.

A text is read into its calendar or epoch fields by patterns of fixed form. An offset, ``Z``, ``GMT``/``UTC``, a zone name or an
abbreviation of the host's zone settles the zone. All other calendar texts are local to the host's clock, whose zone is
*estimated*: the candidates are all zones of the zone database, and each distinct offset history is laid over all of the host's
local texts, the moments are aligned with the ingestion times, and the history with the fewest violations wins (a violation is
an event after its own ingestion, or longer before it than ``PATIENCE``, or a local time the history shows twice or never). The
zone that the ``hosts`` table lists is a tie-break: it wins only among histories whose violations differ from the fewest by no more than
chance (``SLACK`` standard deviations of a count), and where there are no local texts to go by. ``host_zones`` reports where it disagrees.

Bare numbers count from 1970 in the unit their size implies, unless they are calendar stamps of 2025 or 2026. Between slashes
the month comes first, between dots the day. Digits beyond microseconds are cut off; missing seconds are zero.

Defined results (no moment, so no row): null, blank or other texts; dates without a time of day; impossible dates or times
(24:00, second 60); local times that the zone's clocks showed twice or never; abbreviations that the host's zone doesn't use;
local texts of a host that is not listed and has no local text with a load time. Repeated rows give one row. A null id gives a null key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sizes import measured

SLACK = 2.0
PROBE_DAYS = 14
YEARS_US = (-2_208_988_800_000_000, 7_258_118_400_000_000)  # 1900 to 2200: histories are looked up in between
DAY_US = 86_400_000_000
PATIENCE = 3_600_000_000
CACHED_OFFSETS = 1 << 20
STAMP_YEARS = ("2025", "2026")
MINUTE_US = 60_000_000

# English month names.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"\s*(?P<z>[Zz]|[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,6}|[A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)?(?:\[(?P<zn>[A-Za-z_/+\-0-9]+)\])?"
_FORMS = tuple(
    re.compile(p + _ZONE, re.ASCII)
    for p in (
        r"(?P<y>\d{4})-(?P<mo>\d{1,2})-(?P<d>\d{1,2})(?:[Tt]|\s+)" + _TIME,
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})[Tt_ ](?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>(?!))?",
        r"(?P<mo>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4}),?(?:[Tt]|\s+)" + _TIME,
        r"(?P<y>\d{4})/(?P<mo>\d{1,2})/(?P<d>\d{1,2}),?(?:[Tt]|\s+)" + _TIME,
        r"(?P<d>\d{1,2})\.(?P<mo>\d{1,2})\.(?P<y>\d{4}),?(?:[Tt]|\s+)" + _TIME,
        r"(?:[A-Za-z]{3,9},?\s+)?(?P<d>\d{1,2})[ -](?P<mo>[A-Za-z]{3,9})[ -](?P<y>\d{4}),?\s+" + _TIME,
    )
)
_BARE = re.compile(r"([+-]?)(\d+)(?:\.(\d*))?", re.ASCII)
_STAMP = re.compile(r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})?", re.ASCII)
_EPOCH = datetime(1970, 1, 1)


def _micros(moment: datetime) -> int:
    return (moment - _EPOCH) // timedelta(microseconds=1)


def _calendar(y: str, mo: str, d: str, h: str, mi: str, s: str | None, f: str | None, half: str | None = None) -> int | None:
    month = int(mo) if mo[0] in "0123456789" else MONTHS.index(mo[:3].lower()) + 1 if mo[:3].lower() in MONTHS else 0
    hour = int(h)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half in "pP" else 0)
    try:
        return _micros(datetime(int(y), month, int(d), hour, int(mi), int(s or 0), int(((f or "") + "000000")[:6])))
    except ValueError:
        return None


def _epoch(sign: str, whole: str, fraction: str) -> int | None:
    size = len(whole.lstrip("0"))
    shift = 6 if size <= 11 else 3 if size <= 14 else 0 if size <= 17 else -3
    digits = whole + fraction
    point = len(whole) + shift
    us = int(digits[:point].ljust(point, "0") or "0") * (-1 if sign == "-" else 1)
    return us if abs(us) < 1 << 62 else None


def read_clock(text: str | None) -> tuple[int, str | None] | None:
    """Microseconds as the text shows them, and what it says of the zone: ``"="`` for UTC, an offset in minutes, a name, None."""
    if text is None:
        return None
    text = text.strip()
    bare = _BARE.fullmatch(text)
    if bare:
        sign, whole, fraction = bare.groups()
        if not sign and whole[:4] in STAMP_YEARS and fraction is None and len(whole) in (8, 12, 14, 17):
            stamp = _STAMP.match(whole)
            us = stamp and _calendar(*stamp.groups(), whole[14:17])
            if us is not None:
                return us, None
            if len(whole) == 8:
                return None
        us = _epoch(sign, whole, fraction or "")
        return None if us is None else (us, "=")
    for form in _FORMS:
        m = form.fullmatch(text)
        if m:
            us = _calendar(m["y"], m["mo"], m["d"], m["h"], m["mi"], m["s"], m["f"], m["ap"])
            if us is None:
                return None
            zone = m["z"]
            if zone is None:
                return us, m["zn"]
            if zone in "Zz" or zone.upper() in ("GMT", "UTC"):
                return us, "="
            if zone[0] in "+-":
                hours, _, minutes = zone[1:].partition(":")
                if not minutes and len(hours) > 2:
                    hours, minutes = hours[:-2], hours[-2:]
                if int(minutes or 0) > 59 or int(hours) > 18:
                    return None
                return us - (1 if zone[0] == "+" else -1) * (int(hours) * 60 + int(minutes or 0)) * MINUTE_US, "="
            return us, zone
    return None


class Zones:
    """Offset histories, looked up by the quarter of an hour of local time."""

    def __init__(self) -> None:
        self.zones: dict[str, ZoneInfo | None] = {}
        self.offsets: dict[tuple[str, int], int | None] = {}
        self.names: dict[str, dict[str, int | None]] = {}

    def zone(self, name: str) -> ZoneInfo | None:
        if name not in self.zones:
            try:
                self.zones[name] = ZoneInfo(name)
            except (OSError, ValueError):  # ZoneInfoNotFoundError is a KeyError
                self.zones[name] = None
            except KeyError:
                self.zones[name] = None
        return self.zones[name]

    def utc(self, name: str, local: int) -> int | None:
        """The one moment at which the zone's clocks showed ``local``, if there is exactly one."""
        key = (name, local // (15 * MINUTE_US))
        if key not in self.offsets:
            if len(self.offsets) > CACHED_OFFSETS:
                self.offsets.clear()
            zone, offset = self.zone(name), None
            if zone is not None:
                at = (_EPOCH + timedelta(minutes=15 * key[1])).replace(tzinfo=zone)
                first, second = at.utcoffset(), at.replace(fold=1).utcoffset()
                offset = first // timedelta(microseconds=1) if first == second else None
            self.offsets[key] = offset
        offset = self.offsets[key]
        return None if offset is None else local - offset

    def abbreviation(self, name: str, short: str, local: int) -> int | None:
        """The moment, reading ``short`` as the zone uses it around that year."""
        if name not in self.names:
            found: dict[str, int | None] = {}
            zone = self.zone(name)
            for day in range(0, 366 * 70, 14) if zone is not None else ():
                at = datetime(1990, 1, 1, 12, tzinfo=UTC).astimezone(zone) + timedelta(days=day)
                at = at.replace(tzinfo=None).replace(tzinfo=zone)
                shown, offset = (at.tzname() or "").upper(), at.utcoffset() // timedelta(microseconds=1)
                found[shown] = offset if found.get(shown, offset) == offset else None
            self.names[name] = found
        offset = self.names[name].get(short.upper())
        return None if offset is None else local - offset


def placed(zones: Zones, us: int, said: str | None, host_zone: str | None) -> int | None:
    """The moment of a text that was read as ``us`` and says ``said`` of its zone."""
    if said == "=":
        return us
    if said is not None and "/" in said:
        return zones.utc(said, us)
    if host_zone is None:
        return None
    return zones.utc(host_zone, us) if said is None else zones.abbreviation(host_zone, said, us)


def moment(zones: Zones, text: str | None, host_zone: str | None) -> int | None:
    got = read_clock(text)
    return None if got is None else placed(zones, *got, host_zone)


History = tuple[tuple[int, int, int], ...]


def offset_history(zone: ZoneInfo, low: int, high: int) -> History:
    """(first moment, end, offset) of each stretch of one offset between two moments, in microseconds."""

    def offset(us: int) -> int:
        return (_EPOCH + timedelta(microseconds=us)).replace(tzinfo=UTC).astimezone(zone).utcoffset() // timedelta(microseconds=1)

    out, begin, now, at = [], low, offset(low), low
    while at < high:
        ahead = min(at + PROBE_DAYS * DAY_US, high)
        if offset(ahead) != now:
            a, b = at, ahead
            while b - a > 1_000_000:
                middle = a + (b - a) // 2 // 1_000_000 * 1_000_000 if b - a > 2_000_000 else a + 1_000_000
                a, b = (middle, b) if offset(middle) == now else (a, middle)
            out.append((begin, b, now))
            begin, now = b, offset(b)
            at = b
        else:
            at = ahead
    out.append((begin, high, now))
    return tuple(out)


def candidate_zones(low: int, high: int, names: Iterable[str] | None = None) -> dict[History, list[str]]:
    """The zones of the database by offset history between two moments; each distinct history counts once."""
    zones, groups = Zones(), {}
    low = max(low, YEARS_US[0]) // 1_000_000 * 1_000_000
    high = max(low, min(high, YEARS_US[1])) // 1_000_000 * 1_000_000 + 1_000_000
    for name in sorted(available_timezones() if names is None else names):
        zone = zones.zone(name)
        if zone is not None and not name.startswith(("posix", "right")) and name not in ("localtime", "Factory"):
            groups.setdefault(offset_history(zone, low, high), []).append(name)
    return groups


def read_values(values: DataFrame) -> DataFrame:
    """source_table, row_key, host, loaded_us, us and said of every value that is a date with a time of day, or an epoch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_clock(t) for t in batch.column("text").to_pylist()]
            us, said = pa.array([None if g is None else g[0] for g in got], pa.int64()), pa.array([None if g is None else g[1] for g in got], pa.string())
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source_table", "row_key", "host", "loaded_us")), us, said], names=["source_table", "row_key", "host", "loaded_us", "us", "said"])
            yield out.filter(us.is_valid())

    narrow = values.select("source_table", "row_key", "text", "host", F.unix_micros("loaded_at").alias("loaded_us"))
    return narrow.mapInArrow(read, "source_table string, row_key string, host string, loaded_us bigint, us bigint, said string")


def zone_evidence(read: DataFrame, histories: Sequence[History]) -> DataFrame:
    """host, history (its number), n_local, violations: every candidate history against the ingestion times of all local texts."""

    def violations(local: np.ndarray, loaded: np.ndarray, history: History) -> np.ndarray:
        shown, fits = np.zeros(len(local), np.int8), np.zeros(len(local), bool)
        for begin, end, offset in history:
            at = local - offset
            inside = (at >= begin) & (at < end)
            shown += inside
            fits |= inside & (at <= loaded) & (loaded - at <= PATIENCE)
        return ~(fits & (shown == 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("host").dictionary_encode()
            names, host = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            local, loaded = batch.column("us").to_numpy(), batch.column("loaded_us").to_numpy()
            n = np.bincount(host, minlength=len(names))
            bad = np.stack([np.bincount(host, violations(local, loaded, h), len(names)) for h in histories])
            for k, name in enumerate(names):
                row = tally.setdefault(name, [0, np.zeros(len(histories), np.int64)])
                row[0] += int(n[k])
                row[1] += bad[:, k].astype(np.int64)
        hosts = list(tally)
        columns = [[h for h in hosts for _ in histories], [i for _ in hosts for i in range(len(histories))], [tally[h][0] for h in hosts for _ in histories], [int(x) for h in hosts for x in tally[h][1]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "history", "n_local", "violations"])

    local = read.where("said IS NULL AND host IS NOT NULL AND loaded_us IS NOT NULL").select("host", "us", "loaded_us")
    partial = local.mapInArrow(count, "host string, history int, n_local bigint, violations bigint")
    return partial.groupBy("host", "history").agg(F.sum("n_local").alias("n_local"), F.sum("violations").alias("violations"))


def judged_zones(read: DataFrame, hosts: DataFrame) -> DataFrame:
    """As ``host_zones``, over values already read."""
    spark = read.sparkSession
    listed = hosts.where("host IS NOT NULL").groupBy("host").agg(F.min("tz_name").alias("tz_name"))
    span = read.where("said IS NULL").agg(F.min("loaded_us").alias("low"), F.max("loaded_us").alias("high")).first()
    empty = span.low is None
    # What a local text outside these days shows cannot fit its ingestion, so no history is needed there.
    groups = {} if empty else candidate_zones(span.low - PATIENCE - DAY_US, span.high + DAY_US)
    known = spark.createDataFrame([(i, name) for i, names in enumerate(groups.values()) for name in names], "history int, zone string")
    evidence = zone_evidence(read, list(groups)) if groups else spark.createDataFrame([], "host string, history int, n_local bigint, violations bigint")
    best = evidence.groupBy("host").agg(F.min(F.struct("violations", "history")).alias("best"), F.max("n_local").alias("n_local"))
    first = known.groupBy("history").agg(F.min("zone").alias("zone"))  # zones of one history show the same moments; the first name stands for them
    best = best.select("host", "n_local", F.col("best.violations").alias("violations"), F.col("best.history").alias("history")).join(F.broadcast(first), "history").drop("history")
    of_listed = listed.join(F.broadcast(known.withColumnRenamed("zone", "tz_name")), "tz_name").join(evidence.select("host", "history", F.col("violations").alias("listed_violations")), ["host", "history"])
    d = listed.join(best, "host", "full").join(of_listed.select("host", "listed_violations"), "host", "left")
    tie = F.coalesce(F.col("listed_violations") - F.col("violations") <= SLACK * F.sqrt(F.col("violations") + 1), F.lit(False))
    fits = F.col("violations").isNull() | tie
    d = d.withColumn("estimated_zone", F.when(tie, F.col("tz_name")).otherwise(F.col("zone")))
    return d.select(
        "host", "tz_name", "estimated_zone", F.coalesce("n_local", F.lit(0)).cast("bigint").alias("n_local"), "violations", "listed_violations",
        F.when(fits, F.coalesce("tz_name", "zone")).otherwise(F.col("zone")).alias("zone"), (F.col("tz_name").isNotNull() & ~fits).alias("disagrees"),
    )


def host_zones(values: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, tz_name (as listed), estimated_zone, n_local, violations, listed_violations, zone (the one to use) and whether the
    evidence disagrees with the listed zone."""
    return judged_zones(cut(read_values(values)), hosts)


def normalise(values: DataFrame, hosts: DataFrame) -> DataFrame:
    """source_table, row_key and utc_us of every value that names one moment.

    ``values`` has source_table, row_key, text, host and loaded_at.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zones = Zones()
        for batch in batches:
            at = [placed(zones, u, s, z) for u, s, z in zip(*(batch.column(c).to_pylist() for c in ("us", "said", "zone")))]
            got = pa.RecordBatch.from_arrays([batch.column("source_table"), batch.column("row_key"), pa.array(at, pa.int64())], names=["source_table", "row_key", "utc_us"])
            yield got.filter(got.column("utc_us").is_valid())

    read = cut(read_values(values))  # read twice: for the evidence, then for the moments
    zones = measured(judged_zones(read, hosts).where("host IS NOT NULL").select("host", "zone"))
    found = read.join(zones, "host", "left").select("source_table", "row_key", "us", "said", "zone")
    return found.mapInArrow(convert, "source_table string, row_key string, utc_us bigint").distinct()
