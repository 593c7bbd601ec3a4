"""Tree concatenation against the whole encoding, and mixtures against their targets."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.mixing import mix_sources, source_budgets


@pytest.fixture(scope="module")
def enc():
    return tokens.codec("byte_bpe_50k")


def texts(r: random.Random):
    kinds = ["abcdefgh", "好的我们在这里等了", "a1'sb2.re,llé好\n \t  ", "😀🎬", "' re'll", "ab"]
    k = r.choice(kinds)
    return "".join(r.choice(k) for _ in range(r.randint(1, 1500)))


def test_joined_pieces_equal_the_whole(enc):
    r = random.Random(11)
    for _ in range(400):
        t, size = texts(r), r.choice([7, 20, 50, 128])
        cut = tokens.pieces(t, size)
        assert "".join(p for p, _ in cut) == t
        assert tokens.join_all(enc, [(enc.encode_ordinary(p), j) for p, j in cut]) == enc.encode_ordinary(t)


def test_corpus_with_long_texts(spark, enc):
    long = [texts(random.Random(i)) for i in range(12)] + ["好" * 3000, "x y " * 800]
    data = [(i, t, 1) for i, t in enumerate(long)] + [(98, "", 1), (99, None, 1), (97, "short", 1), (97, "short", 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df, long_text=100, piece=40).collect()]
    assert sorted(got) == sorted((i, enc.encode_ordinary(t) if t else []) for i, t, _ in data)
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert sizes[99] == sizes[98] == 0 and sizes[12] == len(enc.encode_ordinary(long[12]))


def test_long_texts_that_repeat_a_key(spark, enc):
    a, b = "x y " * 90, "好的我们 ab " * 70
    data = [(1, a), (1, b), (1, a), (None, a), (None, b), (None, b), (2, b), (1, "short")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    got = [(r["doc_id"], r["ids"]) for r in tokens.encode_corpus(df, long_text=100, piece=40).collect()]
    order = lambda x: (x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(((k, enc.encode_ordinary(t)) for k, t in data), key=order)


def test_texts_without_any_place_to_cut(enc, monkeypatch):
    """A text without spaces is halved, and no call is given more than a piece or a window."""
    longest = []
    real = type(enc).encode_ordinary
    monkeypatch.setattr(type(enc), "encode_ordinary", lambda self, t: longest.append(len(t)) or real(self, t))
    r = random.Random(4)
    for alphabet in ("abcdefgh", "好的我们在这里等了", "a"):
        text = "".join(r.choice(alphabet) for _ in range(30_000))
        longest.clear()
        ids = tokens.encode_whole(enc, text, 1000, 500, 2)
        assert max(longest) < 10_000 or alphabet == "a"
        assert ids == real(enc, text)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_the_tree_on_all_documents(spark):
    from millrace.llm.queries import p8_ids, p8_ids_by_tree

    whole, tree = ({r["doc_id"]: r["ids"] for r in q(spark, "/root/testdata/sf0.001").collect()} for q in (p8_ids, p8_ids_by_tree))
    assert whole == tree and max(map(len, whole.values())) > 600


def test_special_token_text_is_ordinary(spark, enc):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string")
    assert 50256 not in tokens.encode_corpus(df).first()["ids"]


def test_budgets(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("gone", 0.2, 3), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    sizes = spark.createDataFrame([("a", 1000), ("b", 100), ("zero", 10), ("other", 5)], "source string, tokens bigint")
    got = {r["source"]: r for r in source_budgets(sizes, targets).collect()}
    assert got["b"]["budget"] == 400 and got["b"]["epochs"] == 4 and got["b"]["rest"] == 0
    assert got["a"]["budget"] == 667 and got["a"]["epochs"] == 0 and got["gone"]["budget"] == 0 and got["zero"]["budget"] == 0


def test_mixture(spark):
    data = [(i, "word " * (5 + i % 7), "a") for i in range(600)] + [(1000 + i, "term " * 8, "b") for i in range(40)] + [(2000, "x", None), (2001, None, "a"), (2002, "", "b"), (2003, "y", "no target")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mix_sources(df, targets)
    rows = [r.asDict() for r in chosen.collect()]
    assert {r["doc_id"] for r in rows}.isdisjoint({2000, 2001, 2002, 2003}) and len({r["doc_id"] for r in rows}) == len(rows)
    assert max(r["repeats"] for r in rows if r["source"] == "a") == 1 and all(r["repeats"] <= 3 for r in rows)
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["a"]["actual_share"] - 0.8 / 1.0) < 0.01 and abs(s["b"]["actual_share"] - 0.2) < 0.01 and s["gone"]["used_tokens"] == 0
    assert s["b"]["used_tokens"] == sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == "b")
    again = {(r["doc_id"], r["repeats"]) for r in mix_sources(df.repartition(5), targets)[0].collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in rows}
    assert mix_sources(df.limit(0), targets)[0].count() == 0 and mix_sources(df, targets.limit(0))[1].count() == 0


def test_complete_epochs_come_before_a_part(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a") for i in range(20)] + [(100 + i, "w " * 10, "b") for i in range(50)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    repeats = sorted(r["repeats"] for r in mix_sources(df, targets)[0].where("source = 'a'").collect())
    assert repeats == [2] * 10 + [3] * 10


def test_slices_are_cut_until_they_are_small(spark):
    """However small the last slice must be, the choice is the same."""
    df = spark.createDataFrame([(i, "word " * (1 + i % 9), "a") for i in range(3000)] + [(5000 + i, "term " * 3, "b") for i in range(900)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = [{tuple(r) for r in mix_sources(df, targets, leaf=leaf)[0].collect()} for leaf in (1_000_000, 2)]
    assert got[0] == got[1] and len(got[0]) > 1000


def test_heavier_documents_come_first(spark):
    df = spark.createDataFrame([(i, "word " * 5, "a", 1.0 if i % 2 else 0.05) for i in range(2000)] + [(9000 + i, "x " * 5, "b", None) for i in range(1000)], "doc_id bigint, text string, source string, score double")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    chosen = [r["doc_id"] for r in mix_sources(df, targets, weight=F.col("score"))[0].where("source = 'a'").collect()]
    assert 900 < len(chosen) < 1100 and sum(i % 2 for i in chosen) > 0.85 * len(chosen)
