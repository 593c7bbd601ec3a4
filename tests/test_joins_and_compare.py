from pyspark.sql import functions as F

from millrace.operators import compare, joins
from millrace.operators.sample import seeded_sample


def test_coverage_join_ignores_empty_keys(spark):
    base = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "", 7), (4, None, 7)], "id int, k string, note int")
    source = spark.createDataFrame([("a", "x", 1), ("", "y", 2), (None, "z", 3)], "k string, v string, note int")
    j = joins.coverage_join(base, source, "k", "hit")
    assert j.columns == ["id", "k", "note", "v", "hit_note", "hit"]
    assert sorted((r["id"], r["v"], r["hit"]) for r in j.collect()) == [(1, "x", True), (2, None, False), (3, None, False), (4, None, False)]
    assert joins.coverage(j, "id", "hit").first().asDict() == {"base_rows": 4, "matched": 1, "ambiguous": 0, "unmatched": 3, "coverage_percent": 25.0}
    assert joins.coverage(j.limit(0), "id", "hit").first()["coverage_percent"] == 0.0


def test_ambiguity_is_counted(spark):
    base, source = spark.createDataFrame([(1, "a")], "id int, k string"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    c = joins.coverage(joins.coverage_join(base, source, "k"), "id").first()
    assert (c["base_rows"], c["matched"], c["ambiguous"], c["unmatched"]) == (1, 1, 1, 0)


def test_overrides(spark):
    df = spark.createDataFrame([(1, "Raw", "raw"), (2, "raw", "raw"), (3, None, "")], "id int, title string, k string")
    over = spark.createDataFrame([("Raw", "first", 1), ("Raw", "last", 2), ("raw", "", 3), ("", "x", 4), (None, "y", 5)], "title string, target_key string, seq int")
    assert sorted((r["id"], r["k"]) for r in joins.apply_overrides(df, over, "title", "k").collect()) == [(1, "last"), (2, "raw"), (3, "")]
    assert joins.apply_overrides(df, over.limit(0), "title", "k").count() == 3


def test_cardinality(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    got = {r["stage"]: r for r in joins.cardinality([("same", a, a), ("more", a, a.union(a.limit(1)))], "id").collect()}
    assert got["same"]["preserved"] and not got["more"]["preserved"] and got["more"]["change"] == 1 and got["more"]["duplicate_keys"] == 1


def test_agreement(spark):
    df = spark.createDataFrame([("A", "a ", None), ("A", "b", "x")], "g string, h string, i string")
    r = compare.agreement_flags(df, {"gh": ("g", "h"), "gi": ("g", "i"), "gz": ("g", "z")}).collect()
    assert [(x["gh"], x["gi"]) for x in r] == [(True, None), (False, False)] and "gz" not in r[0].asDict()


def test_audit(spark, rows):
    s = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, "c", "p"), (None, "n", "n")], "id int, title string, publisher string")
    t = spark.createDataFrame([(1, " a ", "q"), (2, "b", ""), (4, "d", "p")], "id int, title string, publisher string")
    found = rows(compare.audit(s, t, "id", ["title", "publisher"]))
    assert found == [(1, "publisher", "p", "q"), (3, "missing", None, None), (4, "extra", None, None)]
    v = compare.audit_verdict(s, t, "id", ["title", "publisher"]).first()
    assert (v["source_rows"], v["stored_rows"], v["missing"], v["extra"], v["differing"], v["success"]) == (4, 3, 1, 1, 1, False)
    assert compare.audit_verdict(s, s, "id", ["title"]).first()["success"] is True


def test_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert compare.key_sets(a, b, "k").first().asDict() == {"only_left": 1, "only_right": 1, "common": 1}
    d = sorted((r["k"] is not None, r["k"] or 0, r["side"]) for r in compare.multiset_difference(a, b).collect())
    assert d == [(False, 0, "left"), (True, 1, "left"), (True, 2, "left"), (True, 3, "right")]
    assert compare.listed_keys(spark.range(33), "id", 30).first()["listing"].endswith("29 ... (3 more)")
    assert compare.listed_keys(spark.range(0), "id").first()["n"] == 0


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumn("x", F.lit("y"))
    a, b = (seeded_sample(df.repartition(n), "id").collect() for n in (1, 7))
    assert a == b and len(a) == 20 and [r["id"] for r in a] == sorted(r["id"] for r in a)
    assert seeded_sample(df.limit(3), "id").count() == 3 and seeded_sample(df.limit(0), "id").count() == 0
