"""Mixed timestamp formats and time zones, normalised to seconds since 1970 in UTC.

Raw strings repeat far more often than rows do, so they are first reduced to a dictionary of distinct (date text, time text,
locale, zone), which is parsed once, kept in a folder and extended only by what it doesn't have yet; rows then take their
instants by a join. The join's dictionary side has one row for each key, so a key with very many rows can be split.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipworks.session import shared_folder

RAW = ("date_text", "time_text", "locale", "zone")

# Hours from UTC of the zone names that are printed on receipts.
ZONE_NAMES = {
    "z": 0, "utc": 0, "gmt": 0, "ict": 7, "jst": 9, "cet": 1, "cest": 2, "pst": -8, "pdt": -7, "mst": -7, "mdt": -6,
    "est": -5, "edt": -4, "aest": 10, "aedt": 11,
}
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Order of day, month and year in dates of figures, by language and country; all others write the day first.
MONTH_FIRST, YEAR_FIRST = {"en_US"}, {"ja_JP", "zh_CN", "ko_KR"}

_NAME = "|".join(MONTHS)
_DATES = [
    ("ymd", re.compile(r"(?<!\d)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日")),
    ("dmy", re.compile(r"ng[àa]y:?\s*(\d{1,2})\s*th[áa]ng\s*(\d{1,2})\s*n[ăa]m\s*(\d{4})(?!\d)")),
    ("dmy", re.compile(r"(?<!\d)(\d{1,2})\s*th(?:g|áng|ang)\.?\s*(\d{1,2})\s*,?\s*(\d{4})(?!\d)")),
    ("dMy", re.compile(rf"(?<!\d)(\d{{1,2}})[\s\-./]*({_NAME})[a-z]*\.?[\s\-./,]*(\d{{4}})(?!\d)")),
    ("Mdy", re.compile(rf"(?<![a-z])({_NAME})[a-z]*\.?\s*(\d{{1,2}})\s*,?\s+(\d{{4}})(?!\d)")),
    ("ymd", re.compile(r"(?<!\d)(\d{4})\s*([\-/.])\s*(\d{1,2})\s*\2\s*(\d{1,2})(?!\d)")),
    ("???", re.compile(r"(?<!\d)(\d{1,2})\s*([\-/.])\s*(\d{1,2})\s*\2\s*(\d{4}|\d{2})(?!\d)")),
    ("ymd", re.compile(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?=t\d{6}|(?!\d))")),
]
_EPOCH = re.compile(r"(?<![\d.])(\d{10})(\d{3})?(?![\d.])")
_OFFSET = re.compile(r"(?:\b(?:gmt|utc)\s*([+\-])\s*(\d{1,2})(?::?(\d{2}))?(?!\d))|(?:(?<=\d)\s*([+\-])(\d{2}):?(\d{2})(?![\d:]))")
_ZONE_NAME = re.compile(r"(?:(?<=\d)|\b)(" + "|".join(sorted(ZONE_NAMES, key=lambda z: (-len(z), z))) + r")\b")
_TIME = re.compile(r"(?<![\d:./,\-+])(\d{1,2})\s*(?:[:h])\s*(\d{2})(?:\s*[:m]\s*(\d{2})(?:[.,]\d+)?)?\s*p?(?![\d:])(?:\s*([ap])\.?m\b\.?|\s*(sa|ch)\b)?")
_TIME_PM = re.compile(r"(?<![\d:./,\-+])(\d{1,2})\s*:\s*(\d{2})(?:\s*:\s*(\d{2})(?:[.,]\d+)?)?\s*([ap])\.?m\b\.?()")
_TIME_COMPACT = re.compile(r"(?<!\d)t?(\d{2})(\d{2})(\d{2})(?!\d)()()")
_WEEKDAY = re.compile(r"th[ứu]\s*(?:[2-7]\b|hai|ba|t[ưu]|n[ăa]m|s[áa]u|b[ảa]y)|ch[ủu]\s*nh[ậa]t")


def _plain(text: str | None) -> str:
    if not text:
        return ""
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    return " ".join(text.lower().split())


def _day(year: int, month: int, day: int) -> datetime | None:
    try:
        return datetime(year, month, day)
    except ValueError:
        return None


def _days(kind: str, parts: tuple[str, ...], locale: str | None) -> set[datetime | None]:
    """The possible readings of one date, impossible ones as None."""
    n = [MONTHS.get(p) or int(p) for p in parts]
    if kind != "???":
        order = kind.lower()
        return {_day(n[order.index("y")], n[order.index("m")], n[order.index("d")])}
    year = n[2] if len(parts[2]) == 4 else 2000 + n[2]
    day_first, month_first = _day(year, n[1], n[0]), _day(year, n[0], n[1])
    if locale is None:
        return {d for d in (day_first, month_first) if d} or {None}
    if locale in MONTH_FIRST:
        return {month_first}
    if locale in YEAR_FIRST:
        return {_day(2000 + n[0], n[1], n[2])} if len(parts[2]) == 2 else {d for d in (day_first, month_first) if d} or {None}
    return {day_first}


def _clock(m: re.Match) -> tuple[int, int, int] | None:
    hour, minute, second, half = int(m[1]), int(m[2]), int(m[3] or 0), {"a": "am", "sa": "am", "p": "pm", "ch": "pm"}.get(m[4] or m[5] or "")
    if half == "pm" and hour < 12:
        if not hour:
            return None
        hour += 12
    elif half == "am" and hour == 12:
        hour = 0
    elif half == "am" and hour > 12:
        return None
    return (hour, minute, second) if hour < 24 and minute < 60 and second < 60 else None


def parse_instant(date_text: str | None, time_text: str | None, locale: str | None, zone: str | None) -> int | None:
    """Seconds since 1970 in UTC if the two texts, in either place, fix one instant, else None.

    They must hold one possible date and one time of day, or a count of seconds or milliseconds since 1970. A zone that is
    stated counts, else ``zone`` does. Dates in figures follow ``locale``; where none is known, only if one reading is
    possible. Years of two digits are 20xx, missing seconds are 0, fractions are dropped. A local time that a clock change
    skipped or repeated is none, unless the stated zone tells which.
    """
    text = f"{_plain(date_text)} {_plain(time_text)}".strip()
    if not text:
        return None
    count = _EPOCH.fullmatch(text)
    if count:
        return int(count[1])
    dates: set[datetime | None] = set()
    for kind, pattern in _DATES:
        for m in pattern.finditer(text):
            dates |= _days(kind, tuple(p for p in m.groups() if p not in "-/."), locale)
        text = pattern.sub(lambda m: " " + " " * (len(m[0]) > 1), text)
    if len(dates) != 1 or None in dates:
        return None
    text = _WEEKDAY.sub(" ", text)
    offsets = set()
    for m in _OFFSET.finditer(text):
        hours, minutes = int(m[2] or m[5]), int(m[3] or m[6] or 0)
        if hours > 14 or minutes > 59:
            return None
        offsets.add((hours * 60 + minutes) * (-1 if (m[1] or m[4]) == "-" else 1))
    text = _OFFSET.sub(" ", text)
    offsets |= {ZONE_NAMES[m[1]] * 60 for m in _ZONE_NAME.finditer(text)}
    text = _ZONE_NAME.sub(" ", text)
    times: set[tuple[int, int, int] | None] = set()
    for pattern in (_TIME_PM, _TIME, _TIME_COMPACT):
        times |= {_clock(m) for m in pattern.finditer(text)}
        text = pattern.sub(" ", text)
    if len(times) != 1 or None in times or len(offsets) > 1 or re.search(r"[\d?]", text):
        return None
    (day,), (clock,) = dates, times
    local = day + timedelta(hours=clock[0], minutes=clock[1], seconds=clock[2])
    if offsets:
        return int(local.replace(tzinfo=timezone.utc).timestamp()) - offsets.pop() * 60
    if zone is None:
        return None
    try:
        at = ZoneInfo(zone)
    except Exception:
        return None
    found = {int(local.replace(tzinfo=at, fold=f).timestamp()) for f in (0, 1)}
    found = {e for e in found if datetime.fromtimestamp(e, at).replace(tzinfo=None) == local}
    return found.pop() if len(found) == 1 else None


def parse_raw(raw: DataFrame) -> DataFrame:
    """Adds epoch_s to rows of the columns ``RAW``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [parse_instant(*(None if x is None else x for x in r)) for r in zip(*(rows[c] for c in RAW))]
            yield rows.assign(epoch_s=pd.array(out, dtype="Int64"))

    return raw.mapInPandas(run, "date_text string, time_text string, locale string, zone string, epoch_s long")


#: Changes with the rules of ``parse_instant``, so that instants by older rules aren't read.
RULES = 2


class InstantDictionary:
    """Distinct raw strings with their instants, kept as a table in ``path`` and extended by what is new.

    The default path lies in the folder that the session shares and stays the same, so later runs parse only what no run before
    has seen. Runs at the same time may add a string twice, with the same instant; ``with_instants`` gives a row once for that.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/instants-{RULES}"

    def known(self) -> DataFrame | None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema("date_text string, time_text string, locale string, zone string, epoch_s long").parquet(self.path)

    def extend(self, rows: DataFrame) -> DataFrame:
        """Parses the raw strings that the dictionary hasn't got, over all cores, and returns all of it."""
        raw, known = rows.select(*RAW).distinct(), self.known()
        if known is not None:
            keys = known.select(*(F.col(c).alias(f"k_{c}") for c in RAW))
            match = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in RAW]
            raw = raw.join(keys, match, "left_anti")
        cores = self.spark.sparkContext.defaultParallelism
        parse_raw(raw.repartition(max(cores, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))).write.mode("append").parquet(self.path)
        return self.known()


def with_instants(rows: DataFrame, key: str, terminals: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """(key, epoch_s) of the rows that fix one instant; ``rows`` has key, terminal_id, date_text and time_text.

    A row that occurs twice comes out once; rows without any text, or of unknown terminals without a stated zone, don't. A
    terminal that is listed twice must say the same both times.
    """
    places = terminals.select(F.col("terminal_id").alias("t"), "locale", F.col("clock_zone").alias("zone")).where("t is not null").distinct()
    raw = rows.where(f"`{key}` is not null and (date_text is not null or time_text is not null)").select(F.col(key).alias("key"), "terminal_id", "date_text", "time_text")
    raw = raw.join(places, F.col("terminal_id") == F.col("t"), "left").select("key", *RAW)
    entries = dictionary.extend(raw).where("epoch_s is not null").select(*(F.col(c).alias(f"k_{c}") for c in RAW), "epoch_s")
    return raw.join(entries, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in RAW]).select(F.col("key").alias(key), "epoch_s").distinct()
