"""Named queries of the catalogue operators over the test tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import TITLE_NOTES, canonical_key, loosely_equal, squeeze
from millrace.operators import compare, dedup, joins, nulls, profile, quality
from millrace.operators.casts import add_year, cast_counts, to_contract
from millrace.operators.latest import latest_per_key
from millrace.operators.outliers import outliers
from millrace.operators.sample import seeded_sample
from millrace.plans import contracts as C
from millrace.plans import enrich as enrichment
from millrace.plans.clean import cleaned, squeeze_texts
from millrace.problem_queries import TEXTS, table
from millrace.session import scratch_root

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _counting(sql: str) -> str:
    """``count_if(x)`` as ``count(nullif(x, false))``, which DuckDB counts as bigint."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(nullif({sql[at + 9 : end - 1]}, false)){sql[end:]}"
    return sql


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _counting(sql)
        return f

    return add


# Fixed pieces of SQL
_SQ = lambda c: f"nullif(trim(regexp_replace({c}, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')), '')"
_SPACES = "[\\s\\x0B\\p{Z}\\x{85}\\x{1C}-\\x{1F}]"
_NOTES = "|".join(n.replace(".", "[.]") for n in TITLE_NOTES)
_KEY = lambda c: (
    f"trim(regexp_replace(lower(regexp_replace(regexp_replace(coalesce({c}, ''), '(?i)\\bgiveaway\\b{_SPACES}*$', ''), '(?i)\\({_SPACES}*(?:{_NOTES}){_SPACES}*\\)', ' ', 'g')), '{_SPACES}+', ' ', 'g'))"
)
_CATALOGUE = ", ".join(["id", *TEXTS])
_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_DAY = lambda c: f"case when regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_cast({c} as date) end"


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The raw catalogue with its eleven columns, all loads."""
    return table(spark, d, "games_sample").select("id", *TEXTS)


def _ordered(columns: list[str]) -> list:
    return [F.col(c).asc_nulls_last() for c in columns]


@query(f"""
with latest as (select * from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate desc nulls last, {_LINE}) = 1)
select o_orderkey, o_orderdate, o_totalprice, l_linenumber, l_partkey, l_shipdate, l_orderkey is not null as matched
from orders left join latest on o_orderkey = l_orderkey""")
def flagship_latest_line_per_order(spark: SparkSession, d: str) -> DataFrame:
    """For each order its most recent line item, if it has one."""
    ties = [F.col(c) for c in _LINE.split(", ")]
    lines = latest_per_key(table(spark, d, "lineitem"), ["l_orderkey"], [F.col("l_shipdate").desc_nulls_last(), *ties])
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.lit(True).alias("_m"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.withColumn("matched", F.coalesce("_m", F.lit(False))).drop("l_orderkey", "_m")


@query("select c_custkey, c_name as customer_name, c_mktsegment as customer_segment from customer")
def scan_project_rename(spark: SparkSession, d: str) -> DataFrame:
    return joins.select_prefixed(table(spark, d, "customer"), {"c_name": "customer_name", "c_mktsegment": "customer_segment", "c_absent": "customer_absent"}, "c_custkey")


@query("select row_id, id, title from games_sample where id is not null and title is not null")
def filter_drop_critical_nulls(spark: SparkSession, d: str) -> DataFrame:
    return nulls.drop_incomplete(table(spark, d, "games_sample").select("row_id", "id", "title"), ["id", "title"])


@query(f"select row_id, {', '.join(f'{_SQ(c)} as {c}' for c in TEXTS)} from games_sample")
def text_squeeze_blank_to_null(spark: SparkSession, d: str) -> DataFrame:
    return squeeze_texts(table(spark, d, "games_sample").select("row_id", *TEXTS))


@query(f"select doc_id, md5({_SQ('text')}) as squeezed_md5 from documents")
def text_squeeze_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(squeeze(F.col("text"))).alias("squeezed_md5"))


@query(f"select id, title, {_KEY('title')} as join_key from gamerpower_offers")
def text_canonical_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gamerpower_offers").select("id", "title", canonical_key(F.col("title")).alias("join_key"))


@query("select row_id, lower(trim(publisher)) = lower(trim(developer)) as same_company from games_sample")
def text_loose_equality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "games_sample").select("row_id", loosely_equal(F.col("publisher"), F.col("developer")).alias("same_company"))


@query(f"""
with maps as (select title, min(id) as target_id, max(id) as seq from gamerpower_offers where id % 25 = 0 and title is not null group by title),
last as (select title, 'override ' || cast(seq as varchar) as target from maps)
select g.id, g.title, coalesce(l.target, {_KEY('g.title')}) as join_key from gamerpower_offers g left join last l on g.title = l.title""")
def key_override_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Keys of offers, of which those of every 25th id are overridden; of several overrides of a title the last counts."""
    offers = table(spark, d, "gamerpower_offers").select("id", "title")
    over = offers.where("id % 25 = 0").select("title", F.concat(F.lit("override "), F.col("id").cast("string")).alias("target_key"), F.col("id").alias("seq"))
    blank = offers.where("id % 25 = 1").select("title", F.lit("").alias("target_key"), (F.col("id") + 10**12).alias("seq"))
    return joins.apply_overrides(offers.withColumn("join_key", canonical_key(F.col("title"))), over.unionByName(blank), "title", "join_key")


@query("select distinct text, lang from documents")
def dedup_full_row(spark: SparkSession, d: str) -> DataFrame:
    return dedup.distinct_rows(table(spark, d, "documents").select("text", "lang"))


@query(f"select * from lineitem qualify row_number() over (partition by l_orderkey order by {_LINE}) = 1")
def dedup_by_key_deterministic(spark: SparkSession, d: str) -> DataFrame:
    return dedup.one_per_key(table(spark, d, "lineitem"), "l_orderkey", [F.col(c) for c in _LINE.split(", ")])


@query(f"""
with g as (select id, count(*) as n from (select {_CATALOGUE}, count(*) as m from games_sample group by all) group by id)
select (select count(*) from games_sample) as rows_before, (select count(*) from games_sample) - cast(sum(n) as bigint) as full_duplicates, cast(sum(n) as bigint) as rows_distinct,
cast(sum(n) as bigint) - count(*) as key_duplicates, count(*) as rows_after from g""")
def dedup_two_level_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_counts(catalogue(spark, d), "id")


@query(f"""
select {_CATALOGUE} from (select distinct {_CATALOGUE} from games_sample)
qualify row_number() over (partition by id order by {', '.join(c + ' nulls last' for c in TEXTS)}) = 1""")
def dedup_two_level(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(catalogue(spark, d), "id", _ordered(TEXTS))


@query("select * from events qualify row_number() over (partition by user_id order by ts desc nulls last, event_id) = 1")
def latest_event_per_user(spark: SparkSession, d: str) -> DataFrame:
    return latest_per_key(table(spark, d, "events"), ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id")])


@query(f"""
with k as (select *, {_KEY('title')} as join_key, coalesce(try_strptime(case when regexp_full_match(published_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') then published_date end, '%Y-%m-%d %H:%M:%S'), cast({_DAY('published_date')} as timestamp)) as published from gamerpower_offers)
select join_key, id, title from k where join_key <> ''
qualify row_number() over (partition by join_key order by published desc nulls last, id nulls last, title, published_date nulls last) = 1
union all select join_key, id, title from k where join_key = ''""")
def most_recent_offer_per_title(spark: SparkSession, d: str) -> DataFrame:
    """The most recently published offer of each title; titles without key all stay."""
    keyed = table(spark, d, "gamerpower_offers").withColumn("join_key", canonical_key(F.col("title")))
    p = F.col("published_date")
    at = dedup.recency(p)
    return dedup.most_recent(keyed, "join_key", at, [F.col("id").asc_nulls_last(), F.col("title"), p.asc_nulls_last()]).select("join_key", "id", "title")


@query("""
with batch as (select c_custkey + case when c_custkey % 10 = 0 then 1000000000 else 0 end as c_custkey, upper(c_name) as c_name, c_nationkey, 0.0::double as c_acctbal, cast(null as varchar) as c_mktsegment
  from customer where c_custkey % 5 = 0)
select * from customer where c_custkey not in (select c_custkey from batch) union all select * from batch""")
def upsert_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth customer replaced whole, every tenth new; each sent twice, the later sending wins; a column is missing."""
    old = table(spark, d, "customer")
    changed = old.where("c_custkey % 5 = 0").withColumns(
        {"c_custkey": F.col("c_custkey") + F.when(F.col("c_custkey") % 10 == 0, 10**9).otherwise(0), "c_name": F.upper("c_name"), "unknown": F.lit(1)}
    ).drop("c_mktsegment")
    batch = changed.withColumns({"_seq": F.lit(1), "c_acctbal": F.lit(-1.0)}).unionByName(changed.withColumns({"_seq": F.lit(2), "c_acctbal": F.lit(0.0)}))
    keyless = batch.limit(1).withColumn("c_custkey", F.lit(None).cast("bigint"))
    return dedup.upsert(old, batch.unionByName(keyless), "c_custkey", [F.col("_seq").desc()])[0]


_IMPUTED = ", ".join(f"coalesce({c}, '{C.PLACEHOLDERS[c]}') as {c}" if c in C.PLACEHOLDERS else c for c in ["id", *TEXTS])


@query(f"select row_id, {_IMPUTED} from games_sample where id is not null and title is not null")
def null_policy_impute(spark: SparkSession, d: str) -> DataFrame:
    return nulls.apply_null_policy(table(spark, d, "games_sample").select("row_id", "id", *TEXTS), list(C.CRITICAL), C.PLACEHOLDERS)


@query(f"""
select count(*) as rows_before, count_if(id is null or title is null) as rows_dropped, count_if(id is not null and title is not null) as rows_after,
{', '.join(f"count_if(id is not null and title is not null and {c} is null) as imputed_{c}" for c in [*C.IMPORTANT, *C.DESCRIPTIVE])} from games_sample""")
def null_policy_counts(spark: SparkSession, d: str) -> DataFrame:
    return nulls.null_policy_counts(catalogue(spark, d), list(C.CRITICAL), [*C.IMPORTANT, *C.DESCRIPTIVE])


@query(f"select {', '.join(f'count_if({c} is null) as nulls_{c}' for c in ['id', *TEXTS])} from games_sample")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.null_counts(catalogue(spark, d))


@query(f"select {', '.join(f'count_if({c} is not null and {_SQ(c)} is null) as blanks_{c}' for c in TEXTS)} from games_sample")
def blank_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.blank_counts(catalogue(spark, d))


@query(f"select cast(sum(n) as bigint) as rows, count(*) as rows_distinct, cast(sum(n) as bigint) - count(*) as duplicates from (select {_CATALOGUE}, count(*) as n from games_sample group by all)")
def duplicate_row_count(spark: SparkSession, d: str) -> DataFrame:
    return profile.duplicate_rows(catalogue(spark, d))


@query("""select count(*) as rows, count(distinct id) + max(case when id is null then 1 else 0 end) as keys,
count(*) - count(distinct id) - max(case when id is null then 1 else 0 end) as surplus_rows, min(id) as least_key, max(id) as greatest_key from games_sample""")
def key_metrics(spark: SparkSession, d: str) -> DataFrame:
    return profile.key_metrics(table(spark, d, "games_sample").select("id"), "id")


@query(f"select count_if({_DAY('release_date')} is not null) as valid, count_if(release_date is not null and {_DAY('release_date')} is null) as invalid from games_sample")
def date_validity(spark: SparkSession, d: str) -> DataFrame:
    return profile.date_validity(table(spark, d, "games_sample"), "release_date")


@query(f"select {', '.join(f'count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as distinct_{c}' for c in C.CATEGORIES)} from games_sample")
def categorical_distinct(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_counts(table(spark, d, "games_sample"), list(C.CATEGORIES))


@query(f"""
with g as (select {_CATALOGUE}, count(*) as n from games_sample group by all)
select count(*) as rows_distinct, cast(sum(n) as bigint) - count(*) as duplicates, 11 as columns,
cast(sum(n * ({' + '.join(f'cast({c} is null as int)' for c in ['id', *TEXTS])})) as bigint) as total_nulls,
cast(sum(n * ({' + '.join(f'cast({c} is not null and {_SQ(c)} is null as int)' for c in TEXTS)})) as bigint) as total_blanks,
cast(sum(case when {_DAY('release_date')} is not null then n else 0 end) as bigint) as dates_valid, cast(sum(case when release_date is not null and {_DAY('release_date')} is null then n else 0 end) as bigint) as dates_invalid,
cast(sum(n) as bigint) as rows, count(distinct id) + max(cast(id is null as int)) as keys, cast(sum(n) as bigint) - count(distinct id) - max(cast(id is null as int)) as surplus_rows,
min(id) as least_key, max(id) as greatest_key, {', '.join(f'count(distinct {c}) + max(cast({c} is null as int)) as distinct_{c}' for c in C.CATEGORIES)} from g""")
def full_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.full_profile(catalogue(spark, d), "id", "release_date", C.CATEGORIES)


@query(f"select row_id, cast(id as int) as id, title, {_DAY('release_date')} as release_date from games_sample")
def cast_types(spark: SparkSession, d: str) -> DataFrame:
    return to_contract(table(spark, d, "games_sample").select("row_id", "id", "title", "release_date"), C.TYPES)


@query(f"""select count(id) as id_before, count(id) as id_read, 0::bigint as id_lost, count(release_date) as release_date_before, count({_DAY('release_date')}) as release_date_read,
count_if(release_date is not null and {_DAY('release_date')} is null) as release_date_lost from games_sample""")
def cast_invalid_counts(spark: SparkSession, d: str) -> DataFrame:
    return cast_counts(catalogue(spark, d), C.TYPES)


@query(f"select row_id, {_DAY('release_date')} as release_date, cast(year({_DAY('release_date')}) as int) as release_year from games_sample")
def derive_year(spark: SparkSession, d: str) -> DataFrame:
    return add_year(to_contract(table(spark, d, "games_sample").select("row_id", "release_date"), {"release_date": "date"}), "release_date", "release_year")


_OUT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(f"""
with v as ({' union all '.join(f"select '{c}' as column_name, {c} as value from lineitem" for c in _OUT)}),
b as (select column_name, quantile_disc(value, 0.25) as q1, quantile_disc(value, 0.75) as q3 from v group by 1),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence from b)
select f.column_name, q1, q3, iqr, low_fence, high_fence, count_if(value < low_fence or value > high_fence) as n_outliers from v join f on v.column_name = f.column_name group by all""")
def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    return outliers(table(spark, d, "lineitem"), _OUT)


_FEW = ["l_quantity", "l_discount", "l_tax"]


@query(f"""
with v as ({' union all '.join(f"select '{c}' as column_name, {c} as value from lineitem" for c in _FEW)}),
b as (select column_name, quantile_disc(value, 0.25) as q1, quantile_disc(value, 0.75) as q3 from v group by 1),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence from b)
select f.column_name, q1, q3, iqr, low_fence, high_fence, count_if(value < low_fence or value > high_fence) as n_outliers from v join f on v.column_name = f.column_name group by all""")
def outliers_approximate(spark: SparkSession, d: str) -> DataFrame:
    """By the sketch alone, over columns of few values, where it must hit the exact quartiles."""
    return outliers(table(spark, d, "lineitem"), _FEW, approximate=True)


_EXPECTED = [*C.CATALOGUE_FIELDS, "absent_field"]


@query(f"""
with found as (select column_name from information_schema.columns where table_name = 'games_sample'), expected as (select unnest({_EXPECTED!r}) as column_name)
select column_name, 'missing' as finding from (from expected except from found) union all select column_name, 'extra' from (from found except from expected)""")
def schema_differences(spark: SparkSession, d: str) -> DataFrame:
    missing, extra = quality.schema_difference(table(spark, d, "games_sample"), _EXPECTED)
    return spark.createDataFrame([(c, "missing") for c in missing] + [(c, "extra") for c in extra], "column_name string, finding string")


@query(f"""
with days as (select year({_DAY('release_date')}) as y from games_sample where {_DAY('release_date')} is not null),
b as (select cast(quantile_disc(y, 0.25) as double) as q1, cast(quantile_disc(y, 0.75) as double) as q3 from days)
select 'release_year' as column_name, q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as low_fence, q3 + 1.5 * (q3 - q1) as high_fence, count_if(y < q1 - 1.5 * (q3 - q1) or y > q3 + 1.5 * (q3 - q1)) as n_outliers from days, b group by all""")
def outliers_release_year(spark: SparkSession, d: str) -> DataFrame:
    return outliers(derive_year(spark, d).select("release_year"))


_ONE = f"(select {_CATALOGUE} from (select distinct {_CATALOGUE} from games_sample) qualify row_number() over (partition by id order by {', '.join(c + ' nulls last' for c in TEXTS)}) = 1)"
_SQUEEZED = f"(select id, {', '.join(f'{_SQ(c)} as {c}' for c in TEXTS)} from {_ONE})"
_CLEAN = f"""(select cast(id as int) as id, {', '.join(f"coalesce({c}, '{C.PLACEHOLDERS[c]}') as {c}" if c in C.PLACEHOLDERS else f"{_DAY(c)} as {c}" if c == 'release_date' else c for c in TEXTS)},
cast(year({_DAY('release_date')}) as int) as release_year from {_SQUEEZED} where id is not null and title is not null)"""


@query(f"select * from {_CLEAN}")
def clean_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All cleaning steps in order over the raw catalogue."""
    return cleaned(catalogue(spark, d))


_CHECKS = f"""c as (select * from {_CLEAN}), k as (select count(*) - count(distinct id) - max(cast(id is null as int)) as duplicate_keys, count_if(id is null) + count_if(title is null) as critical_nulls, count(*) as rows,
any_value(typeof(id)) = 'INTEGER' as id_typed, any_value(typeof(release_date)) = 'DATE' as release_date_typed from c)"""


@query(f"with {_CHECKS} select duplicate_keys, critical_nulls, id_typed, release_date_typed, duplicate_keys = 0 and critical_nulls = 0 and id_typed and release_date_typed as valid from k")
def validate_final(spark: SparkSession, d: str) -> DataFrame:
    return quality.final_checks(clean_pipeline(spark, d), "id", list(C.CRITICAL), C.TYPES)


_NULLS = " + ".join(f"cast({c} is null as int)" for c in ["id", *TEXTS])


@query(f"""
with was as (select sum(n - 1) + sum(({_NULLS}) * n) as found from (select {_CATALOGUE}, count(*) as n from games_sample group by all)),
now as (select count(*) as rows, count(*) - count(distinct id) - max(cast(id is null as int)) as surplus, count_if(id is null) + count_if(title is null) as missing from games_sample),
c as (select round(greatest(0, 1 - surplus / rows) * 100, 2) as uniqueness, round(greatest(0, 1 - missing / rows) * 100, 2) as completeness, 0.0::double as typing, round(greatest(0, 1 - (surplus + missing) / found) * 100, 2) as resolution from was, now)
select *, round((uniqueness + completeness + typing + resolution) / 4, 2) as score from c""")
def quality_score_raw(spark: SparkSession, d: str) -> DataFrame:
    """The score that the raw catalogue would get as it is: ids and dates have no contracted type yet."""
    raw = catalogue(spark, d)
    return quality.quality_score(raw, raw, "id", list(C.CRITICAL), C.TYPES)


@query(f"""
with {_CHECKS}, was as (select sum(n - 1) + sum(({_NULLS}) * n) as found from (select {_CATALOGUE}, count(*) as n from games_sample group by all)),
p as (select round(greatest(0, 1 - duplicate_keys / rows) * 100, 2) as uniqueness, round(greatest(0, 1 - critical_nulls / rows) * 100, 2) as completeness, (cast(id_typed as int) + cast(release_date_typed as int)) * 50.0::double as typing,
case when found = 0 then 100.0 else round(greatest(0, 1 - (duplicate_keys + critical_nulls) / found) * 100, 2) end as resolution from k, was)
select *, round((uniqueness + completeness + typing + resolution) / 4, 2) as score from p""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_score(catalogue(spark, d), clean_pipeline(spark, d), "id", list(C.CRITICAL), C.TYPES)


_LATEST6 = f"(select {_CATALOGUE} from games_sample where load_no = 6 and id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last, row_id desc) = 1)"
_CONTRAST = f"(select {_KEY('title')} as join_key, * from mmobomb_games)"
_CONTRAST1 = f"(select * from {_CONTRAST} where join_key <> '' qualify row_number() over (partition by join_key order by id nulls last, title) = 1)"


def _latest_load(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "games_sample").where("load_no = 6")
    return latest_per_key(last, ["id"], [F.col("ingested_at").desc_nulls_last(), F.col("row_id").desc()]).select("id", *TEXTS)


def _prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    none = spark.createDataFrame([], "title string, target_key string, seq bigint")
    offers = enrichment.prepared(table(spark, d, "gamerpower_offers"), C.OFFER_COLUMNS, none, "published_date")
    return offers, enrichment.prepared(table(spark, d, "mmobomb_games"), C.CONTRAST_COLUMNS, none, None)


@query(f"""
with b as (select *, {_KEY('title')} as k from {_LATEST6}), j as (select b.id, c.id is not null as hit from b left join {_CONTRAST1} c on nullif(b.k, '') = c.join_key)
select count(*) as base_rows, cast(count_if(hit) as bigint) as matched, 0::bigint as ambiguous, count(*) - count_if(hit) as unmatched, cast(round(cast(count_if(hit) as decimal(20,0)) * 100 / count(*), 2) as double) as coverage_percent from j""")
def left_join_coverage(spark: SparkSession, d: str) -> DataFrame:
    base = _latest_load(spark, d).withColumn(C.JOIN_KEY, canonical_key(F.col("title")))
    return joins.coverage(joins.coverage_join(base, _prepared(spark, d)[1], C.JOIN_KEY), "id")


_RECENCY = f"coalesce(try_strptime(case when regexp_full_match(published_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') then published_date end, '%Y-%m-%d %H:%M:%S'), cast({_DAY('published_date')} as timestamp)) desc nulls last, published_date desc nulls last"
_OFFERS1 = f"(select * from (select {_KEY('title')} as join_key, * from gamerpower_offers) where join_key <> '' qualify row_number() over (partition by join_key order by {_RECENCY}, id nulls last, title) = 1)"



@query(f"""
with b as (select *, {_KEY('title')} as title_match from {_LATEST6})
select b.*, {', '.join(f'o.{c} as {n}' for c, n in C.OFFER_COLUMNS.items())}, {', '.join(f'c.{k} as {n}' for k, n in C.CONTRAST_COLUMNS.items())}, o.id is not null as _offer, c.id is not null as _contrast,
{', '.join(f'lower(trim(b.{k})) = lower(trim(c.{k})) as {k}_match' for k in C.COMPARED)}
from b left join {_OFFERS1} o on nullif(b.title_match, '') = o.join_key left join {_CONTRAST1} c on nullif(b.title_match, '') = c.join_key""")
def two_source_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """The last load enriched from offers and the contrast catalogue, with agreement flags."""
    return enrichment.enriched(_latest_load(spark, d), *_prepared(spark, d))


_TARGET = "(select min(title) as target from games_sample where load_no = 6 and title is not null)"
_OVERRIDDEN = f"(select case when title is not null and title in (select title from mmobomb_games where id % 20 = 0 and title <> '') then {_KEY('target')} else {_KEY('title')} end as join_key, m.* from mmobomb_games m, {_TARGET})"


@query(f"""
with b as (select *, {_KEY('title')} as title_match from {_LATEST6}),
o as (select * from {_OVERRIDDEN} where join_key <> '' qualify row_number() over (partition by join_key order by id nulls last, title) = 1)
select b.id, b.title_match, o.id as mmobomb_id, lower(trim(b.genre)) = lower(trim(o.genre)) as genre_match from b left join o on nullif(b.title_match, '') = o.join_key""")
def enrichment_with_overrides(spark: SparkSession, d: str) -> DataFrame:
    """The last load enriched from the contrast catalogue by a mapping file that sends every twentieth record to one title."""
    from millrace.sources.files import MAPPING_FIELDS, read_mapping
    from millrace.sources.sinks import write_csv

    contrast = table(spark, d, "mmobomb_games")
    target = table(spark, d, "games_sample").where("load_no = 6").agg(F.min("title").alias("target_title"))
    entries = contrast.where("id % 20 = 0 and title <> ''").select(F.col("title").alias("contrast_title"), F.lit("").alias("offers_title"), F.lit("manual").alias("method")).join(target, how="cross")  # one row
    path = _local_scratch("mapping.csv")
    write_csv(entries.select(*MAPPING_FIELDS), path)
    source = enrichment.prepared(contrast, C.CONTRAST_COLUMNS, enrichment.overrides_for(read_mapping(spark, path), "contrast_title"), None)
    base = _latest_load(spark, d).withColumn(C.JOIN_KEY, canonical_key(F.col("title")))
    joined = joins.coverage_join(base, source, C.JOIN_KEY, "_contrast")
    return compare.agreement_flags(joined, {"genre_match": ("genre", "mmobomb_genre")}).select("id", C.JOIN_KEY, "mmobomb_id", "genre_match")


@query("""
with j as (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by 1)
select count(*) as base_rows, count_if(n > 0) as matched, count_if(n > 1) as ambiguous, count(*) - count_if(n > 0) as unmatched, cast(round(cast(count_if(n > 0) as decimal(20,0)) * 100 / count(*), 2) as double) as coverage_percent from j""")
def coverage_of_ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders joined with all their lines: coverage by order, and the orders that match more than one line."""
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return joins.coverage(joins.coverage_join(base, table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k")), "k"), "o_orderkey")


@query("""select row_id, lower(trim(genre)) = lower(trim(mmobomb_genre)) as genre_agrees, lower(trim(platform)) = lower(trim(mmobomb_platform)) as platform_agrees,
lower(trim(publisher)) = lower(trim(mmobomb_publisher)) as publisher_agrees, lower(trim(developer)) = lower(trim(mmobomb_developer)) as developer_agrees from enriched_games_sample""")
def agreement_flags(spark: SparkSession, d: str) -> DataFrame:
    pairs = {f"{c}_agrees": (c, f"mmobomb_{c}") for c in C.COMPARED} | {"absent_agrees": ("absent", "genre")}
    return compare.agreement_flags(table(spark, d, "enriched_games_sample"), pairs).select("row_id", *list(pairs)[:-1])


@query("""
with j as (select o_orderkey, l_orderkey from orders left join lineitem on o_orderkey = l_orderkey), l as (select distinct l_orderkey from lineitem), k as (select o_orderkey from orders left join l on o_orderkey = l_orderkey)
select 'all lines' as stage, (select count(*) from orders) as rows_before, (select count(*) from j) as rows_after, (select count(*) from j) - (select count(*) from orders) as change, (select count(*) - count(distinct o_orderkey) from j) as duplicate_keys, false as preserved
union all select 'one line', (select count(*) from orders), (select count(*) from k), 0, 0, true""")
def cardinality_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("line"))
    return joins.cardinality([("all lines", orders, orders.join(lines, "o_orderkey", "left")), ("one line", orders, orders.join(lines.distinct(), "o_orderkey", "left"))], "o_orderkey")


@query("""
with c as (select o_orderkey, o_custkey, case when o_orderkey % 97 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 101 <> 0), o as (select o_orderkey, o_custkey, o_orderstatus from orders)
select *, 'left' as side from (select * from o except all select * from c) union all select *, 'right' from (select * from c except all select * from o)""")
def except_all_consistency(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    copy = orders.where("o_orderkey % 101 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")))
    return compare.multiset_difference(orders, copy)


@query("select n_nationkey as k, n_name as name from nation union all select r_regionkey, r_name from region")
def union_all_append(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


@query("""select (select count(*) from (select o_orderkey from orders except select l_orderkey from lineitem)) as only_left, (select count(*) from (select l_orderkey from lineitem except select o_orderkey from orders)) as only_right,
(select count(*) from (select o_orderkey from orders intersect select l_orderkey from lineitem)) as common""")
def key_set_differences(spark: SparkSession, d: str) -> DataFrame:
    return compare.key_sets(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


_COPY = "(select c_custkey, case when c_custkey % 13 = 0 then ' ' || c_name || ' ' when c_custkey % 17 = 0 then c_name || '!' else c_name end as c_name, nullif(c_mktsegment, 'BUILDING') as c_mktsegment from customer where c_custkey % 29 <> 0 union all select c_custkey + 1000000000, c_name, c_mktsegment from customer where c_custkey % 31 = 0)"
_AUDIT = f"""(select coalesce(a.c_custkey, b.c_custkey) as c_custkey, 'missing' as finding, cast(null as varchar) as source_value, cast(null as varchar) as stored_value from customer a left join {_COPY} b on a.c_custkey = b.c_custkey where b.c_custkey is null
union all select b.c_custkey, 'extra', null, null from {_COPY} b left join customer a on a.c_custkey = b.c_custkey where a.c_custkey is null
union all select a.c_custkey, 'c_name', trim(coalesce(a.c_name, '')), trim(coalesce(b.c_name, '')) from customer a join {_COPY} b on a.c_custkey = b.c_custkey where trim(coalesce(a.c_name, '')) <> trim(coalesce(b.c_name, ''))
union all select a.c_custkey, 'c_mktsegment', trim(coalesce(a.c_mktsegment, '')), trim(coalesce(b.c_mktsegment, '')) from customer a join {_COPY} b on a.c_custkey = b.c_custkey where trim(coalesce(a.c_mktsegment, '')) <> trim(coalesce(b.c_mktsegment, '')))"""


def _perturbed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    name = F.when(k % 13 == 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).when(k % 17 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    copy = customer.where(k % 29 != 0).withColumns({"c_name": name, "c_mktsegment": F.nullif("c_mktsegment", F.lit("BUILDING"))})
    return customer, copy.unionByName(customer.where(k % 31 == 0).withColumn("c_custkey", k + 10**9))


@query(f"select * from {_AUDIT}")
def audit_field_diffs(spark: SparkSession, d: str) -> DataFrame:
    return compare.audit(*_perturbed(spark, d), "c_custkey", ["c_name", "c_mktsegment"])


@query(f"""
with f as (select c_custkey, max(finding) as f from {_AUDIT} group by 1)
select (select count(*) from customer) as source_rows, (select count(*) from {_COPY}) as stored_rows, count_if(f = 'missing') as missing, count_if(f = 'extra') as extra, count_if(f not in ('missing', 'extra')) as differing,
(select count(*) from customer) = (select count(*) from {_COPY}) as counts_match, count(*) = 0 as success from f""")
def audit_verdict(spark: SparkSession, d: str) -> DataFrame:
    return compare.audit_verdict(*_perturbed(spark, d), "c_custkey", ["c_name", "c_mktsegment"])


@query("""
with k as (select distinct o_orderkey from orders), t as (select o_orderkey from k order by 1 limit 30)
select (select count(*) from k) as n, (select string_agg(cast(o_orderkey as varchar), ', ' order by o_orderkey) from t) || case when (select count(*) from k) > 30 then ' ... (' || cast((select count(*) from k) - 30 as varchar) || ' more)' else '' end as listing""")
def id_list_truncated(spark: SparkSession, d: str) -> DataFrame:
    return compare.listed_keys(table(spark, d, "orders"), "o_orderkey")


@query("select p_partkey, p_name, p_brand from (select * from part order by md5('42|' || cast(p_partkey as varchar)), p_partkey, p_name, p_brand limit 20) order by p_partkey")
def sample_seeded(spark: SparkSession, d: str) -> DataFrame:
    return seeded_sample(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")


@query("select id, title, genre from games_sample")
def json_wrapper_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """A document that holds its records under a name, written from all of the raw catalogue and read back by contract."""
    from millrace.sources.files import read_json_records

    path = _local_scratch("games.json")
    with open(path, "w", encoding="utf-8") as f:  # noqa: PTH123
        for i, row in enumerate(table(spark, d, "games_sample").select("id", "title", "genre").toJSON().toLocalIterator()):
            f.write(("," if i else '{"games": [') + row)
        f.write("]}")
    return read_json_records(spark, path, C.CATALOGUE, "games").select("id", "title", "genre")


@query("select row_id, title, short_description from games_sample")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All of the raw catalogue as CSV in parts and back; empty texts, quotes and line ends stay."""
    from millrace.sources.files import read_csv
    from millrace.sources.sinks import write_csv

    games = table(spark, d, "games_sample").select("row_id", "title", "short_description")
    path = scratch(spark, "games.csv")
    write_csv(games, path, single=False)
    return read_csv(spark, path, games.schema)


@query("select row_id, id, title, release_date from games_sample")
def sqlite_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from millrace.sources.sqlite import read_sqlite, write_sqlite

    games = table(spark, d, "games_sample").select("row_id", "id", "title", "release_date")
    path = _local_scratch("games.db")
    write_sqlite(games, path, "games", "row_id")
    return read_sqlite(spark, path, "games", games.schema)


@query("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def snapshot_swap_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from millrace.sources.sinks import read_snapshot, swap_snapshot

    path = scratch(spark, "supplier")
    swap_snapshot(table(spark, d, "supplier").limit(1), path)
    swap_snapshot(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return read_snapshot(spark, path)


@query("select user_id, event_id, event_type from events where user_id is not null qualify row_number() over (partition by user_id order by ts desc nulls last, event_id desc) = 1")
def streaming_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of four micro-batches in an order that is not time's, upserted by user: the latest event of each stays."""
    from millrace.streaming.upserts import read_upserted, upsert_stream

    folder = scratch(spark, "stream")
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").alias("_ts"), F.col("event_id").alias("_event"))
    events.repartition(4, "event_type", "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    upsert_stream(stream, f"{folder}/table", "user_id", ["_ts", "_event"], f"{folder}/checkpoint", parts=16).awaitTermination()
    return read_upserted(spark, f"{folder}/table")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder, on whatever file system it is."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def _local_scratch(name: str) -> str:
    """A fresh place on this machine, for formats of single files that the driver writes and reads."""
    return str(Path(tempfile.mkdtemp(prefix="millrace-"), name))
