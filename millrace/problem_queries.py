"""The pN_ queries of the core's problems, over their whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.missing import STAND_INS
from millrace.operators.column_profile import BROKEN_SQL, MARKUP, ill_formed_day, ill_formed_name, load_shifts, profile_columns, quality_findings
from millrace.operators.packed import split_packed
from millrace.operators.reconcile import reconcile
from millrace.operators.snapshots import snapshot_changes
from millrace.operators.timestamps import normalise_timestamps

TEXTS = ["title", "thumbnail", "short_description", "game_url", "genre", "platform", "publisher", "developer", "release_date", "freetogame_profile_url"]
RULES = {"release_date": ill_formed_day(), "publisher": ill_formed_name, "developer": ill_formed_name}
KINDS = {"release_date": lambda v: F.substring(v, 1, 4)}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "enriched_games_sample"), "row_id", ["platform", "gamerpower_platforms"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    fields = ["gamerpower_published_date", "gamerpower_end_date", "release_date"]
    return normalise_timestamps(table(spark, d, "enriched_games_sample"), "row_id", fields, "feed_zone")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality_findings(table(spark, d, "games_sample"), "load_no", "row_id", RULES, KINDS)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_columns(table(spark, d, "games_sample"), "load_no", RULES)


def p5_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Every load and column with its distances to the load before."""
    shifts = load_shifts(table(spark, d, "games_sample"), "load_no", RULES, KINDS)
    return shifts.select("load_no", "column_name", "n_now", "n_before", *(F.round(c, 6).alias(c) for c in ("half_sum", "psi", "chi_square")), "degrees")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    sample = table(spark, d, "games_sample").where("load_no = 6")
    ties = {"left_ties": [F.col("row_id").desc()], "right_ties": [F.col(c) for c in TEXTS]}
    return reconcile(sample, table(spark, d, "games_store"), "id", TEXTS, days=["release_date"], left_name="sample", right_name="store", recent="ingested_at", **ties)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "games_sample"), "load_no", "id", TEXTS, ["ingested_at", "row_id"])


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p5_found, p5_profile, p5_shifts, p6_found, p7_found)}

_ENDS = "[\\s\\p{Z}\\x{200B}\\x{FEFF}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _name_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '^{_ENDS}+|{_ENDS}+$', '', 'g')"
    words = ", ".join(_q(w) for w in STAND_INS)
    tests = [
        f"not regexp_matches({c}, '\\p{{L}}')",
        f"lower({bare}) in ({words})",
        f"{bare} <> {c}",
        f"regexp_matches({c}, {_q(BROKEN_SQL)})",
        f"regexp_matches({c}, {_q(MARKUP)})",
    ]
    return f"({c} is not null and ({' or '.join(tests)}))"


_DAY_SQL = "(value is not null and not coalesce(regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(value as date) between date '1990-01-01' and date '2026-12-31', false))"
_LONG_SQL = f"""
long as (
  select load_no, row_id, column_name, value,
    case when column_name = 'release_date' then {_DAY_SQL} else {_name_sql("value")} end as bad
  from (
    select load_no, row_id, 'release_date' as column_name, release_date as value from games_sample
    union all select load_no, row_id, 'publisher', publisher from games_sample
    union all select load_no, row_id, 'developer', developer from games_sample))"""
_P5_SQL = f"""
with {_LONG_SQL},
freq as (
  select load_no, column_name,
    case when value is null then 'null' when bad then 'ill-formed' when column_name = 'release_date' then '=' || substr(value, 1, 4) else '=' || value end as label,
    count(*) as n
  from long group by all),
total as (select load_no, count(*) as n from games_sample group by 1),
step as (select load_no, lag(load_no) over (order by load_no) as before from (select distinct load_no from games_sample)),
pair as (
  select load_no, column_name, label, n as c1, 0 as c0 from freq where load_no in (select load_no from step where before is not null)
  union all
  select s.load_no, f.column_name, f.label, 0, f.n from freq f join step s on f.load_no = s.before),
gap as (select load_no, column_name, label, sum(c1) as c1, sum(c0) as c0 from pair group by all),
far as (
  select g.load_no, g.column_name from gap g join step s on g.load_no = s.load_no join total a on a.load_no = g.load_no join total b on b.load_no = s.before
  group by g.load_no, g.column_name, a.n, b.n having sum(abs(c1 * b.n - c0 * a.n)) * 5 >= a.n * b.n)
select 'value' as check_name, load_no, column_name, row_id from long where bad
union all select 'shift', load_no, column_name, cast(0 as bigint) from far"""
_P5_SHIFTS_SQL = f"""
{_P5_SQL[: _P5_SQL.index("far as (")].rstrip().rstrip(",")},
sized as (select g.load_no, g.column_name, g.c1, g.c0, sum(c1) over (partition by g.load_no, g.column_name) as n1, sum(c0) over (partition by g.load_no, g.column_name) as n0 from gap g),
share as (select *, greatest(c1, 0.5) / n1 as p, greatest(c0, 0.5) / n0 as q, (c1 + c0) * n1 / (n1 + n0) as e1, (c1 + c0) * n0 / (n1 + n0) as e0 from sized where n1 > 0 and n0 > 0)
select load_no, column_name, cast(max(n1) as bigint) as n_now, cast(max(n0) as bigint) as n_before, round(sum(abs(c1 * n0 - c0 * n1)) / (2.0 * max(n1) * max(n0)), 6) as half_sum, round(sum((p - q) * ln(p / q)), 6) as psi,
  round(sum((c1 - e1) ** 2 / e1 + (c0 - e0) ** 2 / e0), 6) as chi_square, count(*) - 1 as degrees
from share group by load_no, column_name"""
_P5_PROFILE_SQL = f"""
with {_LONG_SQL},
counts as (select load_no, column_name, value, bad, count(*) as n from long group by all)
select load_no, column_name, cast(sum(n) as bigint) as n_rows, cast(sum(case when value is null then n else 0 end) as bigint) as n_null,
  cast(sum(case when bad then n else 0 end) as bigint) as n_ill_formed, count(value) as n_distinct, min(value) as least, max(value) as greatest,
  max(case when value is not null then n end) as n_most_frequent
from counts group by load_no, column_name"""


def _plain_sql(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '')"


def _day_sql(c: str) -> str:
    t = _plain_sql(c)
    midnight = "(?:[T ]00:?00(?::?00(?:[.,]0+)?)?(?: ?(?:Z|UTC|[+-]00:?00))?)?"
    forms = [f"([0-9]{{4}}){s}([0-9]{{1,2}}){s}([0-9]{{1,2}}){midnight}" for s in ("-", "/", "[.]")] + [f"([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){midnight}"]
    cases = " ".join(
        f"when regexp_full_match({t}, '{f}') then coalesce(strftime(try_cast(regexp_replace({t}, '^{f}$', '\\1-\\2-\\3') as date), '%Y-%m-%d'), {t})" for f in forms
    )
    return f"case {cases} else {t} end"


def _plain_list(days: bool) -> str:
    return ", ".join(f"{_day_sql(c) if days and c == 'release_date' else _plain_sql(c)} as {c}" for c in TEXTS)


_P6_SQL = f"""
with a as (select id, {_plain_list(True)} from games_sample where load_no = 6 and id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last, row_id desc) = 1),
b as (select id, {_plain_list(True)} from games_store where id is not null qualify row_number() over (partition by id order by ingested_at desc nulls last, {", ".join(TEXTS)}) = 1)
select id, 'only_in_sample' as finding from a where id not in (select id from b)
union all select id, 'only_in_store' from b where id not in (select id from a)
""" + "\n".join(f"union all select a.id, '{c}' from a join b on a.id = b.id where a.{c} is distinct from b.{c}" for c in TEXTS)
_P7_SQL = f"""
with s as (select load_no, id, {_plain_list(False)} from games_sample where id is not null and load_no is not null
  qualify row_number() over (partition by load_no, id order by ingested_at desc nulls last, row_id desc) = 1),
step as (select load_no, lag(load_no) over (order by load_no) as before from (select distinct load_no from s)),
old as (select step.load_no, s.* exclude (load_no) from s join step on s.load_no = step.before),
new as (select s.* from s join step on s.load_no = step.load_no where step.before is not null)
select coalesce(n.load_no, o.load_no) as load_no, coalesce(n.id, o.id) as id,
  case when o.id is null then 'added' when n.id is null then 'removed' else 'changed' end as change_kind
from new n full join old o on n.load_no = o.load_no and n.id = o.id
where o.id is null or n.id is null or {" or ".join(f"n.{c} is distinct from o.{c}" for c in TEXTS)}"""

ORACLES = {"p5_found": _P5_SQL, "p5_profile": _P5_PROFILE_SQL, "p5_shifts": _P5_SHIFTS_SQL, "p6_found": _P6_SQL, "p7_found": _P7_SQL}
