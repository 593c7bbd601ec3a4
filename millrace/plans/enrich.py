"""Enrich: key, override, most recent per key, join with coverage, compare, check."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import FAILURES, EnrichmentError
from millrace.functions.text import canonical_key
from millrace.operators.casts import to_contract
from millrace.operators.compare import agreement_flags, multiset_difference
from millrace.operators.dedup import most_recent, recency, source_summary
from millrace.operators.joins import apply_overrides, cardinality, coverage, coverage_join, select_prefixed
from millrace.operators.sample import write_sample
from millrace.plans import contracts as C
from millrace.plans.report import flat, render
from millrace.sources.fetch import Fetcher, http_fetcher, land
from millrace.sources.files import read_json_records, read_mapping
from millrace.sources.sinks import read_snapshot, swap_snapshot, write_csv, write_text


@dataclass(frozen=True)
class Integration:
    """What a source brought: its records before and after one per key was taken, and how the base met them."""

    name: str
    records: int
    unique_keys: int
    duplicate_keys: int
    surplus_rows: int
    without_key: int
    matched: int
    unmatched: int
    ambiguous: int
    coverage_percent: float


@dataclass(frozen=True)
class EnrichResult:
    code: int
    rows: int = 0
    offers_matched: int = 0
    contrast_matched: int = 0
    message: str = ""
    sources: tuple[Integration, ...] = ()
    issues: tuple[str, ...] = ()


def base_table(spark: SparkSession, clean: str) -> DataFrame:
    """The cleaned catalogue: a snapshot, a Parquet folder or CSV; without key column or rows it is an error."""
    if clean.endswith(".csv"):
        if not Path(clean).exists():
            raise EnrichmentError(f"{clean} does not exist")
        base = to_contract(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(clean), {**C.TYPES, C.YEAR: "int"})
    elif (base := read_snapshot(spark, clean)) is None:
        raise EnrichmentError(f"{clean} does not exist")
    if C.KEY not in base.columns or "title" not in base.columns:
        raise EnrichmentError(f"{clean} lacks the columns {C.KEY} and title")
    if base.isEmpty():
        raise EnrichmentError(f"{clean} holds no rows")
    return base


def overrides_for(mapping: DataFrame, column: str) -> DataFrame:
    """The mapping's entries for one source: raw title, key of the target title, place in the file."""
    return mapping.select(F.col(column).alias("title"), canonical_key(F.col("target_title")).alias("target_key"), "seq")


def keyed(source: DataFrame, overrides: DataFrame) -> DataFrame:
    """A source with its join key, overridden where the mapping says so."""
    return apply_overrides(source.withColumn(C.JOIN_KEY, canonical_key(F.col("title"))), overrides, "title", C.JOIN_KEY)


def prepared(source: DataFrame, columns: dict[str, str], overrides: DataFrame, priority: str | None) -> DataFrame:
    """A source with its join key, one row per key (the most recent, or without ``priority`` of the least id), prefixed."""
    order = recency(F.col(priority)) if priority else F.lit(None).cast("timestamp")
    ties = [F.col(priority).desc_nulls_last()] if priority else []
    return select_prefixed(most_recent(keyed(source, overrides), C.JOIN_KEY, order, [*ties, F.col("id").asc_nulls_last(), F.col("title")]), columns, C.JOIN_KEY)


def enriched(base: DataFrame, offers: DataFrame, contrast: DataFrame) -> DataFrame:
    """``base`` with its join key, both prepared sources, and the agreement flags; the flags of matching stay as ``_offer``, ``_contrast``."""
    base = base.withColumn(C.JOIN_KEY, canonical_key(F.col("title")))
    joined = coverage_join(coverage_join(base, offers, C.JOIN_KEY, "_offer"), contrast, C.JOIN_KEY, "_contrast")
    return agreement_flags(joined, {f"{c}_match": (c, f"mmobomb_{c}") for c in C.COMPARED})


def integration(name: str, source: DataFrame, overrides: DataFrame, met) -> Integration:
    """The summary of one source; ``met`` is its coverage row."""
    of = source_summary(keyed(source, overrides), C.JOIN_KEY).first()
    return Integration(name, *(of[c] for c in ("records", "unique_keys", "duplicate_keys", "surplus_rows", "without_key")), *(met[c] for c in ("matched", "unmatched", "ambiguous", "coverage_percent")))


def found_issues(base_duplicates: int, stages, changed: int, sources: tuple[Integration, ...]) -> tuple[str, ...]:
    """Why an enrichment is not a success; all must hold: base keys unique, rows kept and unchanged, no ambiguous match."""
    out = [f"the base has {base_duplicates} duplicate keys"] if base_duplicates else []
    out += [] if stages["rows_before"] == stages["rows_after"] else [f"{stages['rows_before']} rows became {stages['rows_after']}"]
    out += [f"{stages['duplicate_keys']} duplicate keys after the joins"] if stages["duplicate_keys"] else []
    out += [f"{changed} rows of the base changed"] if changed else []
    return tuple(out + [f"{s.ambiguous} ambiguous matches in {s.name}" for s in sources if s.ambiguous])


def run(spark: SparkSession, clean: str, folder: str, offers_address: str, contrast_address: str, mapping: str, fetch: Fetcher | None = None) -> EnrichResult:
    """Enrich the cleaned snapshot into ``folder``: exit code 0, 2 if rows were lost, gained or changed, or 1."""
    root = Path(folder)
    get = fetch or http_fetcher()
    try:
        base = base_table(spark, clean)
        raw_offers = read_json_records(spark, land(offers_address, str(root / "raw" / "offers.json"), get), C.OFFERS, C.OFFER_WRAPPER)
        raw_contrast = read_json_records(spark, land(contrast_address, str(root / "raw" / "contrast.json"), get), C.CONTRAST, C.CONTRAST_WRAPPER)
        manual = read_mapping(spark, mapping)
        for_offers, for_contrast = overrides_for(manual, "offers_title"), overrides_for(manual, "contrast_title")
        offers = prepared(raw_offers, C.OFFER_COLUMNS, for_offers, "published_date")
        contrast = prepared(raw_contrast, C.CONTRAST_COLUMNS, for_contrast, None)
        marked = enriched(base, offers, contrast).cache()
        swap_snapshot(marked.drop("_offer", "_contrast"), str(root / "enriched"))
        final = read_snapshot(spark, str(root / "enriched"))
        of_offers, of_contrast = (coverage(marked, C.KEY, f).first() for f in ("_offer", "_contrast"))
        stages = cardinality([("joins", base, final)], C.KEY).first()
        changed = multiset_difference(base, final.select(*base.columns)).count()
        marked.unpersist()
        sources = (integration("offers", raw_offers, for_offers, of_offers), integration("contrast", raw_contrast, for_contrast, of_contrast))
        unique = source_summary(base.withColumn(C.KEY, F.col(C.KEY).cast("string")), C.KEY).first()
        problems = found_issues(unique["surplus_rows"], stages, changed, sources)
        ok = not problems
        new = len(final.columns) - len(base.columns)
        sections = [
            ("columns", {"base": len(base.columns), "join key": 1, "new": new - 1, "enrichment percent": round(100 * new / len(base.columns), 2)}),
            ("base", flat(unique)),
            *((s.name, {k: v for k, v in vars(s).items() if k != "name"}) for s in sources),
            ("cardinality", flat(stages)),
            ("consistency", {"rows of the base that changed": changed}),
            ("issues", list(problems) or ["none"]),
            ("notes", ["keys that are empty join nothing", "of several records of a key the most recent counts, or the one of the least id"]),
            ("lineage", C.lineage()),
        ]
        verdict = "enriched" if ok and of_offers["matched"] + of_contrast["matched"] else "nothing matched" if ok else "rows were not preserved"
        write_text(render("Enrichment of the catalogue", sections, verdict), str(root / "report" / "enrichment.txt"))
        write_csv(final, str(root / "export" / "enriched.csv"), single=False)
        sample = write_sample(final, C.KEY, str(root / "sample" / "enriched_sample.csv"))
        return EnrichResult(0 if ok else 2, sample.of, of_offers["matched"], of_contrast["matched"], sources=sources, issues=problems)
    except FAILURES as e:
        return EnrichResult(1, message=str(e))
