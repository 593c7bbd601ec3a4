"""Forms of game titles under which spellings of one game meet and those of its sequels do not."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Stores and systems that titles carry in brackets at their end.
_STORES = (
    r"steam|gog(?:\.com)?|epic(?: games?)?(?: store)?|itch\.?io|indiegala|drm[- ]free|xbox(?: one)?|pc|playstation(?: ?[45])?|psn?[45]?|nintendo(?: switch)?|switch|origin|ea(?: app)?"
    r"|uplay|ubisoft(?: connect)?|humble(?: bundle)?|microsoft(?: store)?|android|ios|google play|prime gaming|amazon|fanatical|battle\.?net|mac|linux|vr|web browser"
)
#: What may trail behind a title or note.
_ENDING = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000.!?…-–—:"
_NOTES = [
    re.compile(r"\s*\bgiveaway\Z"),
    re.compile(r"\s*[-–—]?\s*\bkeys?\Z"),
    re.compile(rf"\s*[(\[]\s*(?:{_STORES})\s*[)\]]\Z"),
]
# What marks a reissue or a sequel at a title's end.
_REISSUE = "remastered|remaster|remake|redux|definitive edition|anniversary edition|enhanced edition|complete edition|deluxe edition|goty edition|game of the year edition|hd"
_ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "v": "5", "x": "10", "il": "2", "ll": "2", "lii": "3", "lll": "3"}
_MARKER = re.compile(rf"\s+((?:(?:{_REISSUE}|\d{{1,2}}|{'|'.join(_ROMAN)})\s*)+)\Z")
_SYMBOLS = re.compile(r"[™®©℠]")
_MISREAD = str.maketrans("015|", "olsl")


def _folded(title: str) -> str:
    if title.isascii():
        return title.lower()
    t = unicodedata.normalize("NFKD", _SYMBOLS.sub(" ", title))
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()


def _skeleton(tokens: list[str]) -> str:
    """Tokens without the traces of misreading: no spaces, doubled letters once, digits within words as letters."""
    joined = "".join(t.translate(_MISREAD) if not t.isdigit() else t for t in tokens)
    return re.sub(r"(.)\1+", r"\1", joined)


@functools.lru_cache(maxsize=100_000)
def _core(title: str) -> tuple[str, str] | None:
    """What is left of a title without notes, article, punctuation and mark, and its mark (sequel or reissue)."""
    t = _folded(title).strip()
    before = None
    while before != t:
        before = t
        t = t.rstrip(_ENDING)
        if t.endswith("giveaway") or t.endswith(("key", "keys")) or t.endswith((")", "]")):
            for note in _NOTES:
                t = note.sub("", t)
    t = re.sub(r"\s*&\s*", " and ", t)
    t = re.sub(r",\s*the\Z", "", t)
    t = re.sub(r"[^\w]+|_+", " ", t).strip()
    t = re.sub(r"\Athe\s+(?=\S)", "", t)
    if not t:
        return None
    marker = ""
    if m := _MARKER.search(t):
        words = m[1].split()
        marker = " ".join(_ROMAN.get(w, w) for w in words)
        t = t[: m.start()]
    elif m := re.search(r"(?<=\w\w\w)(remastered|rernastered|remake)\Z", t):
        marker, t = "remastered" if m[1][2] in "mr" and m[1] != "remake" else m[1], t[: m.start()]
    return t, marker


def title_key(title: str | None) -> str | None:
    """The key alone of ``title_forms``."""
    core = _core(title) if title is not None else None
    return f"{core[0]} {core[1]}".strip() if core else None


def title_forms(title: str | None) -> dict | None:
    """``key`` (spellings of one title share it), ``marker`` (sequel or reissue), ``skeleton``, ``bases`` and ``tokens``; None if blank.

    Case, accents, width, punctuation, store notes, a leading or trailing article, "&" for "and" and the writing of
    sequel numbers make no difference to the key. ``bases`` are skeletons of shorter titles under which other
    catalogues may list the game: what follows "of", or its first two words. ``tokens`` are skeletons of its longest words.
    """
    core = _core(title) if title is not None else None
    if core is None:
        return None
    t, marker = core
    tokens = t.split()
    bases = set()
    if "of" in tokens[:-2]:
        bases.add(_skeleton(tokens[tokens.index("of") + 1 :]))
    if len(tokens) >= 3 and "of" not in tokens[:3] and "and" not in tokens[:3]:
        bases.add(_skeleton(tokens[:2]))
    whole = _skeleton(tokens)
    long = sorted((_skeleton([w]) for w in tokens if len(w) > 3), key=lambda w: (-len(w), w))[:2]
    return {"key": f"{t} {marker}".strip(), "marker": marker, "skeleton": whole, "bases": sorted(bases - {whole}), "tokens": long}


FORMS = StructType(
    [
        StructField("key", StringType()),
        StructField("marker", StringType()),
        StructField("skeleton", StringType()),
        StructField("bases", ArrayType(StringType())),
        StructField("tokens", ArrayType(StringType())),
    ]
)


@F.pandas_udf(FORMS)
def forms_of(title: pd.Series) -> pd.DataFrame:
    """``title_forms`` of a column; all fields null where there are none."""
    empty = {"key": None, "marker": None, "skeleton": None, "bases": None, "tokens": None}
    return pd.DataFrame([title_forms(t) or empty for t in title], columns=list(empty))


@F.pandas_udf(StringType())
def key_of(title: pd.Series) -> pd.Series:
    """The key alone."""
    return pd.Series([title_key(t) for t in title], dtype=object)


_LEGAL = re.compile(r"[\s,.]+(?:inc|gmbh|ltd|llc|co|corp|s a|ag|limited|company)\Z")


def company_form(name: str | None) -> str | None:
    """A company's name without case, accents, legal form and punctuation; None for stand-ins."""
    from millrace.functions.missing import stands_for_missing

    if stands_for_missing(name):
        return None
    t = re.sub(r"[\s.]+\Z", "", _folded(name).strip())
    before = None
    while before != t:
        before = t
        t = re.sub(r"[\s.,]+\Z", "", _LEGAL.sub("", t))
    return re.sub(r"[^\w]+", " ", t).strip() or None


@F.pandas_udf(StringType())
def company_of(name: pd.Series) -> pd.Series:
    """``company_form`` of a column."""
    return pd.Series([company_form(n) for n in name], dtype=object)
