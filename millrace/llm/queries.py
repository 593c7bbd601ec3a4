"""The pN_ queries of this subpackage's problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.game_matching import match_games
from millrace.llm.mixing import mix_sources
from millrace.llm.sentences import sentence_ends
from millrace.llm.survivors import surviving_values, usable_text, value_precedence, _field_rows
from millrace.llm.titles import key_of
from millrace.llm.tokens import encode_corpus
from millrace.operators.timestamps import normal_form


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


DATE, GAME = "_published", "_game"
P2_TEXTS = ["gamerpower_status", "gamerpower_worth", "publisher"]


def _dated(spark: SparkSession, d: str, more: list[str]) -> DataFrame:
    """Enriched rows with their game and the normal form of their publication."""
    rows = table(spark, d, "enriched_games_sample")
    return rows.select("row_id", "gamerpower_published_date", *more, key_of("title").alias(GAME), normal_form("gamerpower_published_date", "feed_zone").alias(DATE))


def _p2_fields(names: list[str]) -> dict:
    return {"gamerpower_published_date": F.col(DATE).isNotNull()} | {c: usable_text(F.col(c)) for c in names}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = surviving_values(_dated(spark, d, P2_TEXTS), GAME, "row_id", DATE, _p2_fields(P2_TEXTS))
    return found.drop("value")


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per game in long form, undated values ordered by learned precedence."""
    more = [*P2_TEXTS, "title_match", "genre", "platform", "developer", "release_date"]
    return surviving_values(_dated(spark, d, more), GAME, "row_id", DATE, _p2_fields(more), learned=True)


def p2_precedence(spark: SparkSession, d: str) -> DataFrame:
    rows = _field_rows(_dated(spark, d, P2_TEXTS), GAME, "row_id", DATE, {c: usable_text(F.col(c)) for c in P2_TEXTS})
    return value_precedence(rows, GAME, DATE)


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matching records with their confidence."""
    return match_games(*(table(spark, d, t) for t in ("enriched_games_sample", "gamerpower_offers", "mmobomb_games")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select("row_id", "source_id")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k")


def p8_ids_by_tree(spark: SparkSession, d: str) -> DataFrame:
    """The same ids with every text beyond 600 characters put together from pieces of about 100."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text", "byte_bpe_50k", long_text=600, piece=100)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentence_ends(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_survivors, p2_precedence, p4_found, p4_matches, p8_ids, p8_ids_by_tree, p9_mix, p9_shares, p10_found)}
ORACLES: dict[str, str] = {}
