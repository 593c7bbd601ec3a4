import math
import random

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import nulls, outliers, profile, quality
from millrace.operators.casts import add_year, cast_counts, to_contract

SCHEMA = "id bigint, title string, publisher string, short_description string, release_date string"
DIRTY = [(1, "A", "P", "d", "2020-01-15"), (2, "B", None, "", "not a day"), (2, "B", None, "\t", "2020-1-5"), (None, None, "P", "d", "2021-02-30")]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(DIRTY, SCHEMA)


def test_profile_counts(dirty):
    assert profile.null_counts(dirty).first().asDict() == {"nulls_id": 1, "nulls_title": 1, "nulls_publisher": 2, "nulls_short_description": 0, "nulls_release_date": 0}
    assert profile.blank_counts(dirty).first()["blanks_short_description"] == 2
    assert profile.duplicate_rows(dirty.union(dirty)).first().asDict() == {"rows": 8, "rows_distinct": 4, "duplicates": 4}
    assert profile.key_metrics(dirty, "id").first().asDict() == {"rows": 4, "keys": 3, "surplus_rows": 1, "least_key": 1, "greatest_key": 2}
    assert profile.date_validity(dirty, "release_date").first().asDict() == {"valid": 1, "invalid": 3}
    assert profile.distinct_counts(dirty, ["publisher"]).first()[0] == 2
    p = profile.full_profile(dirty, "id", "release_date", ("publisher",)).first()
    assert (p["rows"], p["total_nulls"], p["total_blanks"], p["dates_valid"], p["distinct_publisher"]) == (4, 4, 2, 1, 2)


def test_profile_of_nothing(dirty):
    p = profile.full_profile(dirty.limit(0), "id", "release_date", ("publisher",)).first()
    assert (p["rows"], p["keys"], p["least_key"], p["total_nulls"]) == (0, 0, None, 0)


def test_null_policy(dirty):
    got = nulls.apply_null_policy(dirty, ["id", "title", "absent"], {"publisher": "Unknown", "absent": "x"})
    assert sorted(r["publisher"] for r in got.collect()) == ["P", "Unknown", "Unknown"]
    c = nulls.null_policy_counts(dirty, ["id", "title"], ["publisher", "short_description", "absent"]).first().asDict()
    assert c == {"rows_before": 4, "rows_dropped": 1, "rows_after": 3, "imputed_publisher": 2, "imputed_short_description": 0}


def test_casts_never_fail(spark, dirty):
    types = {"id": "int", "release_date": "date"}
    got = to_contract(dirty, types)
    assert dict(got.dtypes)["id"] == "int" and [r["release_date"] for r in got.collect()] == [datetime.date(2020, 1, 15), None, None, None]
    assert cast_counts(dirty, types).first().asDict() == {"id_before": 3, "id_read": 3, "id_lost": 0, "release_date_before": 4, "release_date_read": 1, "release_date_lost": 3}
    assert "y" not in add_year(dirty, "release_date", "y").columns
    assert add_year(got, "release_date", "y").first()["y"] == 2020
    text = spark.createDataFrame([("12",), ("x",), (None,)], "id string")
    assert [r[0] for r in to_contract(text, {"id": "int"}).collect()] == [12, None, None]


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(v), "t") for i, v in enumerate([1, 2, 3, 4, 5, 100])], "id int, v double, t string").union(spark.createDataFrame([(9, None, "t")], "id int, v double, t string"))
    r = outliers.outliers(df, exclude=("id",)).collect()
    assert len(r) == 1 and (r[0]["q1"], r[0]["q3"], r[0]["n_outliers"]) == (2.0, 5.0, 1)
    assert outliers.outliers(df.select("t")).count() == 0 and outliers.outliers(df.limit(0), ["v"]).count() == 0
    assert outliers.outliers(df, ["v"], approximate=True).first()["n_outliers"] == 1


@pytest.mark.parametrize("leaf", [1, 50, 1_000_000])
def test_quartiles_however_small_a_bracket_must_be(spark, leaf):
    r = random.Random(leaf)
    data = [(r.gauss(0, 1), float(r.choice([1, 1, 1, 2, 9])), None if r.random() < 0.5 else float(i)) for i in range(5000)]
    got = outliers.exact_quartiles(spark.createDataFrame(data, "a double, b double, c double"), ["a", "b", "c"], leaf)
    for i, c in enumerate("abc"):
        values = sorted(d[i] for d in data if d[i] is not None)
        assert got[c] == tuple(values[math.ceil(len(values) * q) - 1] for q in (0.25, 0.75))


def test_checks_and_score(spark, dirty):
    types = {"id": "int", "release_date": "date"}
    bad = quality.final_checks(dirty, "id", ["id", "title"], types).first()
    assert (bad["duplicate_keys"], bad["critical_nulls"], bad["id_typed"], bad["valid"]) == (1, 2, False, False)
    clean = to_contract(dirty.limit(1), types)
    assert quality.final_checks(clean, "id", ["id", "title"], types).first()["valid"] is True
    s = quality.quality_score(dirty, clean, "id", ["id", "title"], types).first()
    assert s["score"] == 100.0
    s = quality.quality_score(dirty, dirty, "id", ["id", "title"], types).first()
    assert (s["uniqueness"], s["completeness"], s["typing"], s["resolution"], s["score"]) == (75.0, 50.0, 0.0, 25.0, 37.5)
    assert quality.quality_score(dirty.limit(0), clean.limit(0), "id", ["id", "title"], types).first()["score"] == 100.0
    assert quality.schema_difference(dirty, ["id", "genre"]) == (["genre"], ["publisher", "release_date", "short_description", "title"])
    assert dirty.select(F.count("*")).first()[0] == 4
