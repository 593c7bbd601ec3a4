"""Several values packed in one field, split by the dialect of least description length."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from millrace.functions.missing import is_stand_in, stands_for_missing
from millrace.operators.skew import join_large_small
from millrace.session import cut

# What may stand between two values of a field.
DELIMITERS = (",", ";", "|", "/", "&", "+", "·", "•", "、", "，", "；", "\n", "\r\n", "\r", "\t", " and ")
#: A value spelled for the first time costs this much a character, and more for each delimiter or quote read as text.
CHAR_BITS, LITERAL_BITS = 5.0, 32.0
#: A text that holds delimiters is no name if each of its parts is offered as one more than this many times as often.
APART = 2
#: Up to this number of kinds of delimiters all their sets are written out as candidates; of more, the best set is searched for.
ALL_SETS = 6

_ANY = "|".join(re.escape(d.strip(" ")) if d.strip(" ") != "and" else r"(?i:\s+and\s+)" for d in sorted(DELIMITERS, key=len, reverse=True))
_DELIMITER = re.compile(_ANY)
#: For the JVM: a value without any of these is a single one.
CANDIDATE = r"[,;|/&+·•、，；\n\r\t]|(?i)\s+and\s+"
_QUOTED = {
    q: re.compile(rf"\s*{q}((?:[^{q}\\]|{q}{q}|\\.)*){q}[^\S\n\r\t]*(?={_ANY}|\s*\Z)", re.S)
    for q in ('"', "'")
}
_MODES = ("", '"', "'")
#: A stand-in that holds a delimiter of its own is one value.
_WHOLE = re.compile(rf"\s*(?i:n/a)\.?[^\S\n\r\t]*(?={_ANY}|\s*\Z)")


def _closing(value: str) -> dict[int, int]:
    """Where each round bracket that opens is closed."""
    opened, out = [], {}
    for i, c in enumerate(value):
        if c == "(":
            opened.append(i)
        elif c == ")" and opened:
            out[opened.pop()] = i
    return out


def _unescape(body: str, quote: str) -> str:
    return re.sub(rf"{quote}{quote}|\\(.)", lambda m: quote if m[1] is None else m[1] if m[1] in "\"'\\/" else m[0], body)


def _atoms(value: str, quote: str) -> list[tuple[int, int, str | None, str]]:
    """(start, end, text within quotes or None, delimiter behind it) of the finest parse under one way of quoting."""
    out, start, at, n = [], 0, 0, len(value)
    text: str | None = None
    fresh = True
    closing = _closing(value) if "(" in value else {}
    while at <= n:
        if fresh and (m := _WHOLE.match(value, at)):
            at = m.end()
        elif fresh and quote and (m := _QUOTED[quote].match(value, at)):
            text, at = _unescape(m[1], quote), m.end()
        fresh = False
        if at == n:
            out.append((start, n, text, ""))
            break
        if value[at] == "(":
            at = closing.get(at, at) + 1  # a bracket that never closes protects nothing
            text = None
            continue
        if m := _DELIMITER.match(value, at):
            out.append((start, at, text, m[0].strip(" ").lower() if m[0].strip() else m[0].strip(" ")))
            start, at, text, fresh = m.end(), m.end(), None, True
            continue
        if text is not None and not value[at].isspace():
            text = None
        at += 1
    return out


def _body(value: str) -> tuple[str, bool]:
    v = value.strip()
    if len(v) > 1 and v[0] + v[-1] in ("[]", "{}"):
        return v[1:-1].strip(), True
    return v, False


def _merge(body: str, atoms: list[tuple[int, int, str | None, str]], delimiters: frozenset[str]) -> list[str]:
    out, start, alone = [], atoms[0][0], True
    for i, (_, end, text, delimiter) in enumerate(atoms):
        if i == len(atoms) - 1 or delimiter in delimiters:
            item = text if alone and text is not None else body[start:end]
            out.append(item.strip())
            start, alone = (atoms[i + 1][0], True) if i < len(atoms) - 1 else (0, True)
        else:
            alone = False
    return [x for x in out if x]


def _sets(kinds: list[str]) -> list[frozenset[str]]:
    return [frozenset(c) for k in range(len(kinds), -1, -1) for c in itertools.combinations(kinds, k)]


def _name(bracketed: bool, quote: str, delimiters: frozenset[str]) -> str:
    return "\x00".join(["[" if bracketed else "", quote, *sorted(delimiters)])


def _readings(value: str) -> Iterator[tuple[bool, str, str, list[tuple[int, int, str | None, str]], list[str]]]:
    """Whether brackets around the field go, the way of quoting, the body, its atoms and their kinds of delimiters."""
    bodies = [(value.strip(), False)]
    if (inner := _body(value))[1]:
        bodies.insert(0, inner)
    for body, bracketed in bodies:
        for quote in _MODES[::-1]:
            if not quote or quote in body:
                atoms = _atoms(body, quote)
                yield bracketed, quote, body, atoms, sorted({a[3] for a in atoms} - {""})


def parses(value: str, readings: list | None = None) -> dict[str, list[str]]:
    """Every dialect that reads ``value`` in its own way, by name, with the items it gives; finest first.

    Readings of more than ``ALL_SETS`` kinds of delimiters are left to ``best_of_many``.
    """
    out: dict[str, list[str]] = {}
    seen: set[tuple[str, ...]] = set()
    for bracketed, quote, body, atoms, kinds in _readings(value) if readings is None else readings:
        for delimiters in _sets(kinds) if len(kinds) <= ALL_SETS else ():
            items = _merge(body, atoms, delimiters)
            if tuple(items) not in seen:
                seen.add(tuple(items))
                out[_name(bracketed, quote, delimiters)] = items
    return out


def _item(body: str, atoms: list, i: int, j: int) -> str:
    """The item made of the atoms ``i`` to ``j``."""
    text = atoms[i][2] if i == j else None
    return (body[atoms[i][0] : atoms[j][1]] if text is None else text).strip()


def possible_items(body: str, atoms: list, kinds: list[str]) -> set[str]:
    """Every item that some set of delimiters gives: of each atom at most one for each kind, so linear in the atoms."""
    ends: dict[str, int] = {}  # where each kind comes next
    out, last = set(), len(atoms) - 1
    for i in range(last, -1, -1):
        if atoms[i][3]:
            ends[atoms[i][3]] = i
        before = atoms[i - 1][3] if i else ""
        until = ends.get(before, last)  # the delimiter before the item stands not within it
        out.update(_item(body, atoms, i, j) for j in {*ends.values(), last} if j <= until)
    return out


def _overhead(kinds: int, items: int) -> float:
    return math.log2(len(DELIMITERS)) * (kinds + max(0, items - 1)) + 2


def best_of_many(value: str, bits: dict[str, float]) -> tuple[str, float, int] | None:
    """(dialect, bits, items) of least description length among the readings of more than ``ALL_SETS`` kinds, or None.

    Branch and bound: a kind is decided where it is first met, and a way is left when what it has cost is more than the
    best; costs only grow. So all sets are decided, as if each were written out.
    """
    best: tuple[float, int, str] | None = None
    for bracketed, quote, body, atoms, kinds in _readings(value):
        if len(kinds) <= ALL_SETS:
            continue
        stack = [(0, 0, 0.0, 0, frozenset(), frozenset())]  # atom, begin of its item, cost, items, delimiters, text
        while stack:
            i, begin, cost, items, inside, text = stack.pop()
            while True:
                delimiter = atoms[i][3]
                end = i == len(atoms) - 1
                if not end and delimiter not in inside and delimiter not in text:
                    stack.append((i, begin, cost, items, inside, text | {delimiter}))
                    inside = inside | {delimiter}
                if end or delimiter in inside:
                    if item := _item(body, atoms, begin, i):
                        cost, items = cost + bits[item], items + 1
                    begin = i + 1
                if end or best is not None and round(cost, 6) > best[0]:
                    break
                i += 1
            if end:
                found = (round((cost if items else bits[""]) + _overhead(len(inside), items), 6), -items, _name(bracketed, quote, inside))
                best = found if best is None else min(best, found)
    return (best[2], best[0], -best[1]) if best else None


def parse(value: str, dialect: str) -> list[str]:
    """The items of ``value`` under a dialect of ``parses``."""
    bracket, quote, *delimiters = dialect.split("\x00")
    body = _body(value)[0] if bracket else value.strip()
    return _merge(body, _atoms(body, quote), frozenset(delimiters))


def spelling_bits(item: str) -> float:
    """What it costs to spell an item once."""
    bare = re.sub(r"\([^()]*\)", "", item)
    literals = len(_DELIMITER.findall(bare)) + sum(bare.count(q) for q in "\"'[]{}")
    return CHAR_BITS * (len(item) + 1) + LITERAL_BITS * literals


@F.pandas_udf(ArrayType(StringType()))
def _names(value: pd.Series, dialect: pd.Series) -> pd.Series:
    return pd.Series([[x for x in parse(v, d) if not stands_for_missing(x)] for v, d in zip(value, dialect, strict=True)])


@F.pandas_udf(StructType([StructField("parts", ArrayType(StringType())), StructField("overhead", DoubleType())]))
def _parted(item: pd.Series) -> pd.DataFrame:
    """The items of the finest parse of an item, and what its separators cost."""
    found = []
    for x in item:
        atoms = _atoms(x, "")
        kinds = frozenset(a[3] for a in atoms) - {""}
        parts = _merge(x, atoms, kinds)
        found.append((parts, _overhead(len(kinds), len(parts))))
    return pd.DataFrame(found, columns=["parts", "overhead"])


#: Stands for the dialect of items of values that ``best_of_many`` reads.
_MANY = "\x01"
_CANDIDATES = ["number", "dialect", "n_items", "overhead", "item", "times", "first", "spelling"]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for number, value in zip(b["number"], b["value"], strict=True):
            known: set[str] = set()
            readings = list(_readings(value))
            for dialect, items in parses(value, readings).items():
                overhead = _overhead(len(dialect.split("\x00")) - 2, len(items))
                for item, times in Counter(items or [""]).items():
                    rows.append((number, dialect, len(items), overhead, item, times, int(item not in known), spelling_bits(item)))
                    known.add(item)
            many = [r for r in readings if len(r[4]) > ALL_SETS]
            for item in sorted(set().union(*(possible_items(*r[2:]) for r in many), {""})) if many else ():
                rows.append((number, _MANY, 0, 0.0, item, 1, int(item not in known), spelling_bits(item)))
        yield pd.DataFrame(rows, columns=_CANDIDATES)


@F.pandas_udf(StructType([StructField("dialect", StringType()), StructField("bits", DoubleType()), StructField("n_items", IntegerType())]))
def _searched(value: pd.Series, items: pd.Series) -> pd.DataFrame:
    found = [best_of_many(v, {x["item"]: x["code_bits"] for x in known}) or (None, None, None) for v, known in zip(value, items, strict=True)]
    return pd.DataFrame(found, columns=["dialect", "bits", "n_items"])


def code_lengths(codes: DataFrame, total: int) -> DataFrame:
    """``item`` and its ``code_bits``, of items with ``n``, the values that offer them, and ``spelling``, of ``total`` offers.

    The more values there are, the less the spelling of a common list of names costs each, until the list is cheaper than
    its names. So an item all of whose parts are names without it (``APART``) costs no less than these and their separators.
    What one value alone offers is spelled out by that value, which always costs more.
    """
    bits = codes.select("item", "n", (F.lit(math.log2(total)) - F.log2("n") + F.col("spelling") / F.col("n")).alias("code_bits"))
    lists = bits.where((F.col("n") > 1) & F.col("item").rlike(CANDIDATE)).withColumn("s", _parted("item")).where(F.size("s.parts") > 1)
    parts = cut(lists.select(F.col("item").alias("whole"), F.col("n").alias("together"), F.size("s.parts").alias("size"), "s.overhead", F.explode("s.parts").alias("item")))
    counts = cut(parts.groupBy("item").agg(F.count("*").alias("uses")))
    uses = max(1, counts.agg(F.sum("uses").alias("n")).first()["n"] or 0)
    known = join_large_small(parts, bits, "item", counts, "uses", uses)
    apart = known.groupBy(F.col("whole").alias("item")).agg(
        (F.sum("code_bits") + F.first("overhead")).alias("least_bits"),
        ((F.count("*") == F.first("size")) & (F.min("n") > APART * F.first("together"))).alias("apart"),
    )
    return bits.join(apart.where("apart"), "item", "left").select("item", F.greatest("code_bits", "least_bits").alias("code_bits"))


def choose_dialects(values: DataFrame) -> DataFrame:
    """For distinct ``value``, each with a ``number`` of its own, the ``dialect`` of least description length: ``number``, ``dialect``, ``bits``.

    An item's code length is -log2 of its share among the items that the parses of all values offer, each
    value counting once, and its spelling shared among the values that use it; a list of names costs no less than
    its names (``code_lengths``). Both are counted over all values in one pre-aggregated shuffle. Equal lengths go
    to the parse of more items.
    """
    schema = "number bigint, dialect string, n_items int, overhead double, item string, times int, first int, spelling double"
    # few bytes and much work: spread over all cores, and written once for the counts and the scores
    spread = values.select("number", "value").repartition(2 * values.sparkSession.sparkContext.defaultParallelism)
    cand = cut(spread.mapInPandas(_candidates, schema))
    codes = cut(cand.groupBy("item").agg(F.sum("first").alias("n"), F.first("spelling").alias("spelling")))
    total = max(1, codes.agg(F.sum("n").alias("n")).first()["n"] or 0)
    coded = join_large_small(cand.drop("spelling", "first"), cut(code_lengths(codes, total)), "item", codes, "n", total)
    many = F.col("dialect") == _MANY
    scored = coded.where(~many).groupBy("number", "dialect").agg((F.sum(F.col("code_bits") * F.col("times")) + F.first("overhead")).alias("bits"), F.first("n_items").alias("n_items"))
    if not cand.where(many).isEmpty():
        # one value's items, some tens for each of its own
        lists = coded.where(many).groupBy("number").agg(F.collect_list(F.struct("item", "code_bits")).alias("items")).join(values.select("number", "value"), "number")
        found = lists.select("number", _searched("value", "items").alias("s")).select("number", "s.dialect", "s.bits", "s.n_items")
        scored = scored.unionByName(found)
    best = scored.groupBy("number").agg(F.min(F.struct(F.round("bits", 6).alias("bits"), -F.col("n_items"), "dialect")).alias("best"))
    return best.select("number", "best.dialect", "best.bits")


def split_packed(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per value packed in ``fields``: ``key``, ``field_name``, ``item_no`` (from 1), ``item``; fields of two or more.

    Every distinct text is parsed once: candidate dialects (a set of delimiters and a way of quoting) are
    scored by description length and the cheapest reads the text. Delimiters within quotes or closed
    round brackets never separate; quotes are taken off and doubled or backslashed quote marks restored;
    empty items and stand-ins for missing values take no number; items are trimmed.

    Null and blank fields, and fields of one value, give no row; an empty table gives an empty result;
    repeated rows give repeated results; other columns are not read. The table is read once; a text held by a
    large share of the rows is counted before any shuffle and its parse sent to the rows, not the rows to it.
    """
    parts = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]
    long = cut(
        df.select(F.col(key), F.explode(F.array(*parts)).alias("p"))
        .select(key, "p.field_name", "p.value")
        .where(F.col("value").rlike(CANDIDATE) & ~is_stand_in(F.col("value")))
    )
    values = cut(long.groupBy("value").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()))
    total = max(1, values.agg(F.sum("n").alias("n")).first()["n"] or 0)
    parsed = cut(
        choose_dialects(values)
        .join(values, "number")
        .withColumn("items", _names("value", "dialect"))
        .where(F.size("items") > 1)
        .select("value", "items")
    )
    return (
        join_large_small(long, parsed, "value", values, "n", total)
        .select(key, "field_name", F.posexplode("items").alias("item_no", "item"))
        .withColumn("item_no", F.col("item_no") + 1)
    )
