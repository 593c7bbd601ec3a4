from pyspark.sql import functions as F

from millrace.functions.text import audit_text, canonical_key, is_blank, loosely_equal, squeeze
from millrace.operators import dedup
from millrace.operators.latest import latest_per_key

SCHEMA = "id bigint, title string, platform string, seq int"


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_squeeze_and_blank(spark):
    assert one(spark, squeeze, "  a \t\n b ") == "a b"
    assert one(spark, squeeze, " \t ") is None and one(spark, squeeze, None) is None and one(spark, squeeze, "") is None
    assert one(spark, is_blank, "\t") is True and one(spark, is_blank, None) is False and one(spark, is_blank, "x") is False


def test_canonical_key(spark):
    cases = {
        None: "", "": "", "Warframe (Steam) Giveaway": "warframe", "Giveaway Giveaway": "giveaway", "(Steam)": "", "X (steam) Giveaway (Steam)": "x giveaway",
        "A  B (itch.io)": "a b", "Name (2019)": "name (2019)", "Nb sp x": "nb sp x", "Battle (battleXnet)": "battle (battlexnet)",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", canonical_key(F.col("v")).alias("k"))
    assert {r["v"]: r["k"] for r in df.collect()} == cases


def test_loose_equality_is_three_valued(spark):
    df = spark.createDataFrame([("A ", " a"), ("a", "b"), (None, "a"), ("a", None), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(loosely_equal(F.col("a"), F.col("b"))).collect()] == [True, False, None, None, None]
    assert one(spark, audit_text, None) == ""


def test_deduplicate_levels_and_counts(spark, rows):
    data = [(1, "a", "x", 1), (2, "b", "y", 1), (2, "b", "y ", 1), (2, "b", "y", 1), (None, None, "z", 1), (None, "c", "z", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    order = [F.col(c).asc_nulls_last() for c in ("title", "platform", "seq")]
    got = rows(dedup.deduplicate(df, "id", order))
    assert got == [(None, "c", "z", 1), (1, "a", "x", 1), (2, "b", "y", 1)]
    assert dedup.duplicate_counts(df, "id").first().asDict() == {"rows_before": 6, "full_duplicates": 1, "rows_distinct": 5, "key_duplicates": 2, "rows_after": 3}
    assert rows(dedup.deduplicate(df.repartition(7), "id", order)) == got
    assert dedup.deduplicate(df.drop("id"), "id", order).count() == 5
    assert dedup.duplicate_counts(df.limit(0), "id").first()["rows_after"] == 0


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "id int, _rank int, _n int")
    assert [tuple(r) for r in latest_per_key(df, ["id"], [F.col("_rank").desc()]).collect()] == [(1, 6, 2)]
    assert dedup.duplicate_counts(df, "id").first()["key_duplicates"] == 1


def test_most_recent_keeps_rows_without_key(spark, rows):
    data = [("k", "2020-01-01", 1), ("k", "2021-05-05", 2), ("k", "N/A", 3), ("", "2020-01-01", 4), ("", None, 5), (None, None, 6)]
    df = spark.createDataFrame(data, "key string, d string, id int")
    got = dedup.most_recent(df, "key", dedup.recency(F.col("d")), [F.col("id").asc_nulls_last()])
    assert sorted(r["id"] for r in got.collect()) == [2, 4, 5, 6]


def test_upsert_replaces_whole_rows(spark, rows):
    old = spark.createDataFrame([(1, "a", "p", 0), (2, "b", "p", 0)], SCHEMA)
    batch = spark.createDataFrame([(2, "b2", 1, "x"), (2, "b3", 2, "x"), (3, "c", 1, "x"), (None, "n", 1, "x")], "id bigint, title string, _seq int, extra string")
    table, rejected = dedup.upsert(old, batch, "id", [F.col("_seq").desc()])
    assert rows(table) == [(1, "a", "p", 0), (2, "b3", None, None), (3, "c", None, None)]
    assert rejected.count() == 1
    again, _ = dedup.upsert(table, batch, "id", [F.col("_seq").desc()])
    assert rows(again) == rows(table)
    assert rows(dedup.upsert(old, batch.limit(0), "id", [F.col("_seq").desc()])[0]) == rows(old)


def test_a_hot_key_reaches_no_single_task(spark):
    df = spark.range(30_000).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    got = latest_per_key(df, ["k"], [F.col("id").desc()])
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert got.where("k = -1").first()["id"] == 29_997
