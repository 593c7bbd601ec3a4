"""Texts made from metric rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime

RULE = "-" * 72


def render(title: str, sections: Iterable[tuple[str, Mapping[str, object] | Iterable[str]]], verdict: str, at: datetime | None = None) -> str:
    """A text of named sections, each of ``name: value`` lines or of given lines, ending with a verdict."""
    lines = [title, f"made {(at or datetime.now()).isoformat(' ', 'seconds')}", RULE]
    for heading, body in sections:
        lines.append(heading.upper())
        rows = [f"  {k}: {v}" for k, v in body.items()] if isinstance(body, Mapping) else [f"  {line}" for line in body]
        lines += rows or ["  nothing"]
        lines.append("")
    return "\n".join([*lines, RULE, f"VERDICT: {verdict}", ""])


def flat(row) -> dict[str, object]:
    """A metric row as a dictionary; null as a dash."""
    return {k: "-" if v is None else v for k, v in row.asDict().items()}
