"""Reading dates and times of many notations: shape masks, one parser per mask, zone tables.

Everything here works on whole pandas columns. A value's *mask* has ``9`` for each digit and ``A`` for
each letter, other characters as they are, so that positions in the mask are positions in the value. A
mask is compiled once (per Python worker) to the places of year, month, day and time, or to nothing;
all values of the mask are then cut at those places together. Local times are moved to UTC through
tables of a zone's transitions, which carry the version of the zone data that they were made from.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pandas as pd

# Month names, without accents, lower-cased; the first three letters also stand alone.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar marz april mai juni juli august september oktober november dezember",
    "fr": "janvier fevrier mars avril mai juin juillet aout septembre octobre novembre decembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro marco abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
}
# Abbreviations of zones, as minutes east of Greenwich.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
#: Zones whose feeds write the month before the day between slashes.
MONTH_FIRST = ("America/", "US/")


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).strip(". ")


def _month_table() -> dict[str, int]:
    table: dict[str, int] = {}
    for names in MONTHS.values():
        for number, name in enumerate(names.split(), 1):
            table.setdefault(name, number)
    for names in MONTHS.values():
        for number, name in enumerate(names.split(), 1):
            for short in (name[:3], name[:4]):
                table.setdefault(short, number)
    table["juin"], table["juil"] = 6, 7  # share their first letters
    return table


_MONTH = _month_table()

# Masks of whole values. "A" is a letter, "9" a digit; everything behind the clock time is the tail.
_CLOCK = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?"
_REST = rf"(?:(?:A|,? +){_CLOCK}(?P<tail>.*))?"
_LEAD = r"(?:A{2,12}\.?,? +)?"
_SHAPES = [
    re.compile(rf"{_LEAD}(?P<y>9999)(?P<sep>[-/.])(?P<m>9{{1,2}})(?P=sep)(?P<d>9{{1,2}}){_REST}"),
    re.compile(rf"(?P<y>9999)年 ?(?P<m>9{{1,2}})月 ?(?P<d>9{{1,2}})日{_REST}"),
    re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)(?:[A ](?P<H>99)(?P<M>99)(?P<S>99)?(?:[.,](?P<f>9{1,9}))?(?P<tail>.*))?"),
    re.compile(rf"{_LEAD}(?P<a>9{{1,2}})(?P<sep>[./-])(?P<b>9{{1,2}})(?P=sep)(?P<y>9999|99){_REST}"),
    re.compile(rf"{_LEAD}(?P<d>9{{1,2}})(?:AA|A)?\.?(?: +|-)(?:AA +)?(?P<mon>A{{3,12}})\.?,?(?: +|-)(?:AA +)?(?P<y>9999){_REST}"),
    re.compile(rf"{_LEAD}(?P<mon>A{{3,12}})\.? +(?P<d>9{{1,2}})(?:AA)?,? +(?P<y>9999){_REST}"),
]
_EPOCH = re.compile(r"9{9,20}")
_KEEP = "年月日"


_MASK = str.maketrans("0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "9" * 10 + "A" * 52)


def mask_of(value: str) -> str:
    """The character-class shape of ``value``, character for character."""
    if value.isascii():
        return value.translate(_MASK)
    return "".join("9" if c.isdigit() else "A" if c.isalpha() and c not in _KEEP else c for c in value)


@functools.lru_cache(maxsize=100_000)
def parser_of(mask: str) -> dict[str, slice] | None:
    """Where the mask has its parts, or None if it is no date's."""
    if _EPOCH.fullmatch(mask):
        return {"epoch": slice(0, len(mask))}
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            return {k: slice(*m.span(k)) for k, v in m.groupdict().items() if v is not None}
    return None


_TAIL = re.compile(
    r"\s*(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?:(?P<name>[A-Za-z]{1,5})?\s*(?P<off>[+-]\d{1,2}(?::?\d{2})?)?)?\s*(?:\[(?P<zone>[A-Za-z_/+\-0-9]+)\])?\s*"
)


@functools.lru_cache(maxsize=10_000)
def tail_of(tail: str) -> tuple[str, int | None, str | None] | None:
    """("", "a" or "p"; fixed offset in seconds; zone name) of what follows the clock; None if it can't be read."""
    m = _TAIL.fullmatch(tail)
    if not m:
        return None
    half = (m["ap"] or "")[:1].lower()
    name, off, zone = (m["name"] or "").upper(), m["off"], m["zone"]
    if name and name not in ABBREVIATIONS:
        return None
    if off:
        digits = off[1:].replace(":", "")
        hours, minutes = (int(digits), 0) if len(digits) <= 2 else (int(digits[:-2]), int(digits[-2:]))
        if hours > 18 or minutes > 59 or (name and name not in ("UTC", "GMT", "UT", "Z")):
            return None
        return half, (1 if off[0] == "+" else -1) * (hours * 60 + minutes) * 60, None
    if name:
        return half, ABBREVIATIONS[name] * 60, None
    if zone:
        return half, None, zone
    return half, None, None


@functools.lru_cache(maxsize=1)
def zone_data_version() -> str:
    """The release of the zone data in use."""
    from zoneinfo import TZPATH

    for folder in TZPATH:
        zi = Path(folder, "tzdata.zi")
        if zi.exists():
            with zi.open() as f:
                first = f.readline()
            if first.startswith("# version"):
                return first.split()[-1]
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:  # noqa: BLE001
        return "unknown"


@functools.lru_cache(maxsize=1000)
def transitions(zone: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(instants, offsets) in seconds: offsets[0] holds before instants[0], offsets[i] from instants[i-1] on; 1900 to 2100.

    ``version`` names the zone data and keys the cache with the zone. None for a name that is no zone's.
    """
    from zoneinfo import ZoneInfo

    try:
        info = ZoneInfo(zone)
    except Exception:  # noqa: BLE001
        return None
    start, end = datetime(1900, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)
    offset = lambda s: int((start + timedelta(seconds=s)).astimezone(info).utcoffset().total_seconds())
    step, last, base = 7 * 86400, int((end - start).total_seconds()), int(start.timestamp())
    instants, offsets, at, known = [], [offset(0)], 0, offset(0)
    while at < last:
        now = offset(at + step)
        if now != known:
            low, high = at, at + step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == known else (low, mid)
            known = offset(high)
            instants.append(base + high)
            offsets.append(known)
            at = high
        else:
            at += step
    return np.array(instants, dtype="int64"), np.array(offsets, dtype="int64")


def to_utc(local: np.ndarray, zone: str, version: str) -> np.ndarray | None:
    """Seconds of local time to UTC: the first of two occurrences, a skipped time by the offset before the change."""
    table = transitions(zone, version)
    if table is None:
        return None
    instants, offsets = table
    switch = instants + np.maximum(offsets[:-1], offsets[1:])  # local time from which the later offset holds alone
    return local - offsets[np.searchsorted(switch, local, side="right")]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and which are real."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    month = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = month.astype("datetime64[M]").astype("datetime64[D]").astype("int64")
    after = (month + 1).astype("datetime64[M]").astype("datetime64[D]").astype("int64")
    day = first + d - 1
    return day, ok & (day < after)


def normal_forms(values: pd.Series, zones: pd.Series, default_zone: str = "UTC") -> pd.Series:
    """``YYYY-MM-DDTHH:MM:SS.ffffffZ`` of values with a time of day, ``YYYY-MM-DD`` of those without, else None.

    Each distinct mask is compiled once; the values of a mask are one matrix of characters, whose columns become numbers
    together.
    """
    out = np.full(len(values), None, dtype=object)
    version = zone_data_version()
    text = [(v if v.isascii() else unicodedata.normalize("NFKC", v)).strip() if isinstance(v, str) else "" for v in values]
    feed = np.array([z if isinstance(z, str) and z else default_zone for z in zones], dtype=object)
    by_mask: dict[str, list[int]] = {}
    for i, v in enumerate(text):
        if v:
            by_mask.setdefault(mask_of(v), []).append(i)
    for mask, rows in by_mask.items():
        parser = parser_of(mask)
        if parser is not None:
            at = np.array(rows)
            _fill(out, at, [text[i] for i in rows], feed[at], parser, version)
    return pd.Series(out, index=values.index, dtype=object)


class _Columns:
    """Values of one mask as a matrix of characters."""

    def __init__(self, text: list[str], parser: dict[str, slice]) -> None:
        self.text, self.parser = text, parser
        self.codes = np.array(text, dtype=f"U{len(text[0])}").view(np.uint32).reshape(len(text), -1)

    def number(self, part: str, most: int = 18) -> np.ndarray:
        """The digits of a part, of its first ``most``, as numbers; digits of any script count."""
        where = self.parser[part]
        where = slice(where.start, min(where.stop, where.start + most))
        digits = self.codes[:, where].astype("int64") - 48
        if ((digits < 0) | (digits > 9)).any():
            return np.array([int(v[where]) for v in self.text], dtype="int64")
        return digits @ 10 ** np.arange(digits.shape[1] - 1, -1, -1, dtype="int64")

    def words(self, part: str) -> tuple[list[str], np.ndarray]:
        """The distinct texts of a part, and which of them each value has."""
        where = self.parser[part]
        if where.stop == where.start:
            return [""], np.zeros(len(self.text), dtype="int64")
        found, which = np.unique(np.ascontiguousarray(self.codes[:, where]).view(f"U{where.stop - where.start}").ravel(), return_inverse=True)
        return found.tolist(), which


def _fill(out: np.ndarray, at: np.ndarray, text: list[str], feed: np.ndarray, parser: dict[str, slice], version: str) -> None:
    columns = _Columns(text, parser)
    number = columns.number
    n = len(at)
    if "epoch" in parser:
        digits = parser["epoch"].stop
        if digits <= 11:
            micros = number("epoch") * 1_000_000
        elif digits <= 14:
            micros = number("epoch") * 1_000
        elif digits <= 17:
            micros = number("epoch")
        else:
            micros = np.array([int(v) // 1_000 for v in text], dtype="int64")
        _emit(out, at, micros, np.ones(n, bool))
        return
    y = number("y")
    if parser["y"].stop - parser["y"].start == 2:
        y = y + 2000
    if "mon" in parser:
        names, which = columns.words("mon")
        m, d = np.array([_MONTH.get(_plain(w), 0) for w in names], dtype="int64")[which], number("d")
    elif "a" in parser:
        a, b = number("a"), number("b")
        zones, which = np.unique(feed.astype(str), return_inverse=True)
        slashes = text[0][parser["sep"]] == "/"
        month_first = np.array([slashes and str(z).startswith(MONTH_FIRST) for z in zones], dtype=bool)[which]
        m, d = np.where(month_first, a, b), np.where(month_first, b, a)
    else:
        m, d = number("m"), number("d")
    day, ok = _days(y, m, d)
    if "H" not in parser:
        out[at[ok]] = np.datetime_as_string(day[ok].astype("datetime64[D]"), unit="D").astype(object)
        return
    hour, minute = number("H"), number("M")
    second = number("S") if "S" in parser else np.zeros(n, "int64")
    micro = number("f", 6) * 10 ** max(0, 6 - (parser["f"].stop - parser["f"].start)) if "f" in parser else np.zeros(n, "int64")
    words, which = columns.words("tail")
    tails = [tail_of(w) for w in words]
    ok &= np.array([x is not None for x in tails])[which] & (minute < 60) & (second < 60)
    half = np.array([x[0] if x else "" for x in tails])[which]
    ok &= np.where(half == "", hour < 24, (hour >= 1) & (hour <= 12))
    hour = np.where(half == "", hour, hour % 12 + np.where(half == "p", 12, 0))
    local = day * 86400 + hour * 3600 + minute * 60 + second
    utc = local - np.array([x[1] if x and x[1] is not None else 0 for x in tails], dtype="int64")[which]
    own = np.array([x[2] if x else None for x in tails], dtype=object)[which]
    fixed = np.array([bool(x) and x[1] is not None for x in tails])[which]
    zone = np.where(fixed, "", np.where(own == None, feed, own)).astype(str)  # noqa: E711
    names, which = np.unique(zone, return_inverse=True)
    for i, name in enumerate(names.tolist()):
        if name:
            here = which == i
            moved = to_utc(local[here], name, version)
            if moved is None:
                ok[here] = False
            else:
                utc[here] = moved
    _emit(out, at, utc * 1_000_000 + micro, ok)


def _emit(out: np.ndarray, at: np.ndarray, micros: np.ndarray, ok: np.ndarray) -> None:
    forms = np.datetime_as_string(micros.astype("datetime64[us]"), unit="us")
    good = np.flatnonzero(ok & (np.char.str_len(forms) == 26))  # years 0000 to 9999
    out[at[good]] = np.char.add(forms[good], "Z").astype(object)
