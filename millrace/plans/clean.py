"""Clean: profile, deduplicate, normalise, impute, cast, derive, validate, score."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import FAILURES, CheckError
from millrace.functions.text import squeeze
from millrace.operators.casts import add_year, cast_counts, to_contract
from millrace.operators.dedup import deduplicate, duplicate_counts
from millrace.operators.nulls import apply_null_policy, null_policy_counts
from millrace.operators.outliers import outliers
from millrace.operators.profile import full_profile, text_columns
from millrace.operators.quality import final_checks, quality_score, schema_difference
from millrace.operators.sample import write_sample
from millrace.plans import contracts as C
from millrace.plans.report import flat, render
from millrace.sources.sqlite import read_sqlite
from millrace.sources.sinks import read_snapshot, swap_snapshot, write_csv, write_text


@dataclass(frozen=True)
class CleanResult:
    code: int
    rows: int = 0
    score: float = 0.0
    message: str = ""


SQLITE_TABLE = "games"


def issues(checks) -> list[str]:
    """What the final checks object to, in words."""
    out = [f"{checks['duplicate_keys']} duplicate keys"] if checks["duplicate_keys"] else []
    out += [f"{checks['critical_nulls']} missing values in critical columns"] if checks["critical_nulls"] else []
    return out + [f"{k.removesuffix('_typed')} has not the type it should have" for k, v in checks.asDict().items() if k.endswith("_typed") and not v]


def squeeze_texts(df: DataFrame) -> DataFrame:
    """Every text column squeezed, blanks as null."""
    texts = set(text_columns(df))
    return df.select(*(squeeze(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns))


def cleaned(raw: DataFrame) -> DataFrame:
    """All steps in order; deduplication comes before texts are squeezed, so rows that differ only in spaces are told by key."""
    one = deduplicate(raw, C.KEY, [F.col(c).asc_nulls_last() for c in raw.columns if c != C.KEY])
    full = apply_null_policy(squeeze_texts(one), list(C.CRITICAL), C.PLACEHOLDERS)
    return add_year(to_contract(full, C.TYPES), C.DATE, C.YEAR)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The raw catalogue at ``store``: a snapshot, or the table ``games`` of a SQLite file; without rows it is an error."""
    if store.endswith((".db", ".sqlite", ".sqlite3")):
        return read_sqlite(spark, store, SQLITE_TABLE)
    raw = read_snapshot(spark, store)
    if raw is None or raw.isEmpty():
        raise CheckError(f"{store} holds no records")
    return raw


def run(spark: SparkSession, store: str, folder: str) -> CleanResult:
    """Clean the catalogue at ``store`` into ``folder`` (``clean`` as Parquet, CSV, sample, report): exit code 0, 2 with issues, or 1."""
    root = Path(folder)
    try:
        raw = stored(spark, store).drop("ingested_at")
        missing, extra = schema_difference(raw, list(C.CATALOGUE_FIELDS))
        if set(missing) & set(C.CRITICAL):
            raise CheckError(f"{store} lacks {', '.join(missing)}")
        swap_snapshot(cleaned(raw), str(root / "clean"))
        clean = read_snapshot(spark, str(root / "clean"))
        squeezed = squeeze_texts(deduplicate(raw, C.KEY, [F.col(c).asc_nulls_last() for c in raw.columns if c != C.KEY]))
        checks = final_checks(clean, C.KEY, list(C.CRITICAL), C.TYPES).first()
        score = quality_score(raw, clean, C.KEY, list(C.CRITICAL), C.TYPES).first()
        sections = [
            ("columns", {"missing": ", ".join(missing) or "none", "extra": ", ".join(extra) or "none"}),
            ("before", flat(full_profile(raw, C.KEY, C.DATE, C.CATEGORIES).first())),
            ("duplicates", flat(duplicate_counts(raw, C.KEY).first())),
            ("missing values", flat(null_policy_counts(squeezed, list(C.CRITICAL), [*C.IMPORTANT, *C.DESCRIPTIVE]).first())),
            ("types", flat(cast_counts(squeezed, C.TYPES).first())),
            ("outliers", [", ".join(f"{k} {v}" for k, v in r.asDict().items()) for r in outliers(clean, exclude=(C.KEY,)).collect()]),
            ("after", flat(full_profile(clean, C.KEY, C.DATE, C.CATEGORIES).first())),
            ("issues", issues(checks) or ["none"]),
            ("checks", flat(checks)),
            ("quality", flat(score)),
        ]
        code = 0 if checks["valid"] else 2
        verdict = "clean" if code == 0 and score["score"] >= 95 else "usable, with remarks" if code == 0 else "has issues"
        write_text(render("Cleaning of the catalogue", sections, verdict), str(root / "report" / "cleaning.txt"))
        write_csv(clean, str(root / "export" / "cleaned.csv"), single=False)
        sample = write_sample(clean, C.KEY, str(root / "sample" / "cleaned_sample.csv"))
        return CleanResult(code, sample.of, score["score"])
    except FAILURES as e:
        return CleanResult(1, message=str(e))
