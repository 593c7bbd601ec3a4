"""Encoding of a corpus with a public byte-level tokenizer, long texts by tree concatenation."""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where vocabulary files lie; a parameter of every operator.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the pattern that cuts text into units no token crosses.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters are cut into pieces of about so many, encoded in parallel.
LONG_TEXT, PIECE = 200_000, 50_000
#: Threads that encode the pieces of one text.
THREADS = 4


@functools.lru_cache(maxsize=4)
def codec(name: str, folder: str = TOKENIZER_DIR):
    """The tokenizer, made once per Python worker."""
    import tiktoken

    with Path(folder, f"{name}.tiktoken").open("rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    return "s" if c.isspace() else unicodedata.category(c)[0] if unicodedata.category(c)[0] in "LN" else "o"


def _certain(text: str, p: int) -> bool:
    """Whether a unit of the pattern begins at ``p`` whatever surrounds it: a space behind a non-space."""
    return text[p].isspace() and not text[p - 1].isspace()


def pieces(text: str, size: int = PIECE) -> list[tuple[str, bool]]:
    """``text`` in pieces of about ``size`` characters, with whether a piece must be joined to the one before.

    Cuts are made where a unit surely begins; a stretch without any such place is halved until its parts are small.
    """
    out: list[tuple[str, bool]] = []
    at, n = 0, len(text)
    while n - at > size:
        cut = next((p for p in range(at + size, at + size // 2, -1) if _certain(text, p)), 0)
        if not cut:
            cut = next((p for p in range(at + size + 1, n) if _certain(text, p)), n)
            out += _halves(text[at:cut], size)
        else:
            out.append((text[at:cut], False))
        at = cut
    if at < n:
        out.append((text[at:], False))
    return out


def _halves(stretch: str, size: int, joined: bool = False) -> list[tuple[str, bool]]:
    if len(stretch) <= size:
        return [(stretch, joined)]
    middle = len(stretch) // 2
    return _halves(stretch[:middle], size, joined) + _halves(stretch[middle:], size, True)


def join_encodings(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of two adjoining texts from their own encodings.

    A window of tokens around the join is encoded anew, and grows until its result begins with the left side's and
    ends with the right side's tokens for so long that the units within both are the same: four whole units on either
    side, or all of a side. The pattern looks no further than three characters, so what lies outside stays.
    """
    if not left or not right:
        return left + right
    width = 16
    while True:
        a, b = max(0, len(left) - width), min(len(right), width)
        a = _to_text(enc, left, a, -1)
        b = _to_text(enc, right, b, 1)
        window = enc.decode_bytes(left[a:] + right[:b]).decode("utf-8")
        again = enc.encode_ordinary(window)
        whole = a == 0 and b == len(right)
        if whole:
            return again
        if _agree(enc, left[a:], right[:b], again, a == 0, b == len(right)):
            return left[:a] + again + right[b:]
        width *= 2


def _to_text(enc, tokens: list[int], at: int, step: int) -> int:
    """The nearest place from ``at`` on in direction ``step`` where the bytes between tokens are whole characters."""
    while 0 < at < len(tokens) and 0x80 <= enc.decode_single_token_bytes(tokens[at])[0] < 0xC0:
        at += step
    return at


def _agree(enc, left: list[int], right: list[int], again: list[int], from_start: bool, to_end: bool) -> bool:
    head = _common(left, again)
    tail = _common(right[::-1], again[::-1])
    return (from_start or _anchored(enc, left[:head])) and (to_end or _anchored(enc, right[len(right) - tail :])) and head + tail <= len(again)


def _common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _anchored(enc, shared: list[int]) -> bool:
    """Whether tokens that both encodings share prove that they go on alike beyond.

    Byte-pair encodings of one stretch are the same on both sides of a token that both have if each pair of
    neighbours also encodes to itself; a handful of shared tokens whose pairs do is asked for.
    """
    if len(shared) < 8:
        return False
    for x, y in zip(shared, shared[1:], strict=False):
        both = enc.decode_bytes([x, y])
        try:
            text = both.decode("utf-8")
        except UnicodeDecodeError:
            if list(enc._encode_single_piece(both)) != [x, y]:
                return False
        else:
            if enc.encode_ordinary(text) != [x, y]:
                return False
    return True


def join_all(enc, parts: list[tuple[list[int], bool]]) -> list[int]:
    """Neighbouring encodings joined two by two, tree by tree, until one is left."""
    while len(parts) > 1:
        level = []
        for i in range(0, len(parts) - 1, 2):
            (a, first), (b, joined) = parts[i], parts[i + 1]
            level.append((join_encodings(enc, a, b) if joined else a + b, first))
        if len(parts) % 2:
            level.append(parts[-1])
        parts = level
    return parts[0][0] if parts else []


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype="int32")
    np.cumsum(np.fromiter(map(len, rows), dtype="int32", count=len(rows)), out=offsets[1:])
    flat = np.fromiter((t for row in rows for t in row), dtype="int32", count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_whole(enc, text: str | None, long_text: int = LONG_TEXT, piece: int = PIECE, threads: int = THREADS) -> list[int]:
    """The ids of one text, without special tokens; none of null and empty ones.

    A text of more than ``long_text`` characters is cut into pieces that ``threads`` threads encode in parallel (the
    tokenizer works outside the interpreter's lock), and joined as a tree: places where a unit surely begins need
    nothing, elsewhere windows around the join are encoded anew until both sides agree exactly. No call encodes more
    than a piece or a window.
    """
    if not text:
        return []
    if len(text) <= long_text:
        return enc.encode_ordinary(text)
    found = pieces(text, piece)
    coded = enc.encode_ordinary_batch([p for p, _ in found], num_threads=threads)
    return join_all(enc, [(ids, joined) for ids, (_, joined) in zip(coded, found, strict=True)])


def encode_corpus(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR,
    long_text: int = LONG_TEXT, piece: int = PIECE, threads: int = THREADS,
) -> DataFrame:
    """``key`` and ``ids`` (array of int, never null) of every row, without special tokens.

    One narrow pass that reads the corpus once and shuffles nothing: a row's text lies in one task anyway, so the
    pieces of a long one go to threads of its task (``encode_whole``).

    Null and empty texts have empty ids; rows that repeat a key or have none are encoded each; an empty table gives an
    empty result; other columns are not read.
    """
    typed = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(tokenizer, folder)
        for b in batches:
            rows = [encode_whole(enc, t, long_text, piece, threads) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows)], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {typed}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``tokens`` (bigint), the number of tokens of each text; 0 for null and empty ones."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(tokenizer, folder)
        for b in batches:
            counts = np.array([len(encode_whole(enc, t)) for t in b.column(len(keep)).to_pylist()], dtype="int64")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts)], names=[*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", tokens bigint")
