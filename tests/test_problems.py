"""The core's problems against brute force, and at their edges."""

import datetime
import itertools
import json
import random
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import instants
from millrace.functions.canonical import day_or_text
from millrace.functions.missing import is_stand_in, stands_for_missing
from millrace.operators import packed, reconcile, skew, snapshots
from millrace.operators.column_profile import ill_formed_day, ill_formed_name, load_shifts, profile_columns, quality_findings
from millrace.operators.latest import latest_per_key
from millrace.operators.timestamps import normalise_timestamps

NAMES = ["Steam", "PC (Windows)", "PC (Windows, 64-bit)", "Xbox Series X|S", "iOS", "Handheld & Dock", "Tablet 10\"", "Web Browser", "GOG"]


def pack(items, delimiter, style):
    special = re.compile(r"[|&\"]")
    if style == "json":
        return json.dumps(items)
    quote = '"' if style == "some" else style
    cell = lambda x: quote + x.replace(quote, quote * 2) + quote if style != "some" or special.search(x) else x
    return delimiter.join(map(cell, items))


# --- packed fields
def test_split_packed_against_how_fields_were_made(spark, rows):
    r = random.Random(3)
    data, want = [], []
    for i in range(400):
        items = r.sample(NAMES, r.randint(1, 5))
        text = pack(items, r.choice([", ", ";", " | ", "/", " & ", " and ", "\n", "\t", "、"]), r.choice(["some", "some", '"', "json"]))
        data.append((i, text, None, "clash"))
        want += [(i, "a", k, x) for k, x in enumerate(items, 1)] if len(items) > 1 else []
    df = spark.createDataFrame(data, "row_id bigint, a string, b string, item string")
    assert rows(packed.split_packed(df, "row_id", ["a", "b"])) == sorted(want)


def test_split_packed_at_its_edges(spark, rows):
    data = [(1, None), (2, ""), (3, "N/A"), (4, "Steam, N/A"), (5, "Steam,, iOS,"), (6, " Steam | iOS\t"), (7, "(a, b"), (8, ", ".join(["Steam", "iOS"] * 5000)), (5, "Steam,, iOS,")]
    got = rows(packed.split_packed(spark.createDataFrame(data, "row_id int, p string"), "row_id", ["p"]))
    of = lambda k: [t[2:] for t in got if t[0] == k]
    assert of(1) == of(2) == of(3) == of(4) == []
    assert of(5) == [(1, "Steam"), (1, "Steam"), (2, "iOS"), (2, "iOS")] and of(6) == [(1, "Steam"), (2, "iOS")]
    assert of(7) == [(1, "(a"), (2, "b")] and len(of(8)) == 10_000
    assert packed.split_packed(spark.createDataFrame([], "row_id int, p string"), "row_id", ["p"]).count() == 0


def test_a_name_that_holds_a_delimiter_stays_whole(spark, rows):
    data = [(i, f"Dungeons & Dragons; {x}") for i, x in enumerate(["Steam", "iOS", "GOG", "VR", "Mac", "Linux"])] + [(10 + i, f"{a}; {b}") for i, (a, b) in enumerate([("Steam", "iOS"), ("GOG", "VR"), ("Mac", "Steam")])]
    got = rows(packed.split_packed(spark.createDataFrame(data, "row_id int, p string"), "row_id", ["p"]))
    assert (0, "p", 1, "Dungeons & Dragons") in got and len(got) == 18


def test_a_common_list_of_names_is_no_name(spark, rows):
    """The spelling of a list that many texts hold costs each of them little; still its names are names without it."""
    texts = [f"{' ' * i}PC (Windows), Steam{' ' * j}" for i in range(5) for j in range(5)]
    others = [f"{a}{d}{b}" for a, b in itertools.permutations(["PC (Windows)", "Steam", "iOS", "GOG", "VR", "Mac", "Linux"], 2) for d in (";", " | ", "/", ", ") if (a, b) != ("PC (Windows)", "Steam")]
    data = [(i, x) for i, x in enumerate(texts + others + [f"Handheld & Dock; {x}" for x in ("PC (Windows)", "Steam", "iOS", "GOG", "VR", "Mac")])]
    got = rows(packed.split_packed(spark.createDataFrame(data, "row_id int, p string"), "row_id", ["p"]))
    assert [t[2:] for t in got if t[0] < len(texts)] == [(1, "PC (Windows)"), (2, "Steam")] * len(texts)
    assert [t[3] for t in got if t[0] >= len(data) - 6 and t[2] == 1] == ["Handheld & Dock"] * 6 and len(got) == 2 * len(data)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab,;|/&\"'()[] \n\\", max_size=30))
def test_every_parse_can_be_repeated(text):
    for dialect, items in packed.parses(text).items():
        assert packed.parse(text, dialect) == items


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab,;|/&+·\"'(", min_size=8, max_size=24), st.randoms(use_true_random=False))
def test_search_finds_the_best_of_all_sets(text, r):
    """Where sets are too many to write out, the search gives the description length of the best of all of them."""
    readings = list(packed._readings(text))
    bits = {"": 3.0}
    for _, _, body, atoms, kinds in readings:
        items = packed.possible_items(body, atoms, kinds)
        bits |= {x: bits.get(x, r.randint(1, 60) / 2) for x in sorted(items)}
        assert items >= {x for d in packed._sets(kinds) for x in packed._merge(body, atoms, d)}
    want = []
    for _, _, body, atoms, kinds in readings:
        for d in packed._sets(kinds):
            items = packed._merge(body, atoms, d)
            want.append(round(sum(bits[x] for x in items or [""]) + packed._overhead(len(d), len(items)), 6))
    limit, packed.ALL_SETS = packed.ALL_SETS, -1
    try:
        dialect, found, n = packed.best_of_many(text, bits)
    finally:
        packed.ALL_SETS = limit
    assert found == min(want) and len(packed.parse(text, dialect)) == n


def test_a_field_of_seven_kinds_of_delimiters(spark, rows):
    data = [(i, f"Dungeons & Dragons; {x}") for i, x in enumerate(["Steam", "iOS", "GOG", "VR", "Mac", "Linux"])] + [(10 + i, f"Either/Or; {x}") for i, x in enumerate(["Steam", "iOS", "GOG", "VR"])]
    data += [(99, "Dungeons & Dragons; Steam, iOS | GOG + VR · Mac • Linux, Either/Or")]
    got = [t[3] for t in sorted(rows(packed.split_packed(spark.createDataFrame(data, "row_id int, p string"), "row_id", ["p"])), key=lambda t: t[2]) if t[0] == 99]
    assert got == ["Dungeons & Dragons", "Steam", "iOS", "GOG", "VR", "Mac", "Linux", "Either/Or"]


@pytest.mark.parametrize("share, limit", [(0.1, 1 << 20), (0.1, 0), (0.9999, 0)])
def test_hot_keys_join_like_any(spark, rows, share, limit):
    large = spark.createDataFrame([("h", i) for i in range(50)] + [("c", 1), (None, 2), ("z", 3)], "k string, i int")
    small = spark.createDataFrame([("h", "H"), ("h", "H2"), ("c", "C"), ("q", "Q")], "k string, v string")
    counts = large.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.join_large_small(large, small, "k", counts, "n", 53, share, limit)
    assert got.columns == ["k", "i", "v"] and rows(got) == rows(large.join(small, "k"))
    assert skew.join_large_small(large.limit(0), small, "k", counts.limit(0), "n", 1).count() == 0


# --- timestamps
CASES = [
    ("2024-01-05 07:30:39 +0100", "Europe/Berlin", "2024-01-05T06:30:39.000000Z"),
    ("2021-03-04", "Asia/Tokyo", "2021-03-04"),
    (" 2023-05-01t10:00:00z ", None, "2023-05-01T10:00:00.000000Z"),
    ("2022-10-14 02:07:32,028", "UTC", "2022-10-14T02:07:32.028000Z"),
    ("03/04/2021 13:55", "America/New_York", "2021-03-04T18:55:00.000000Z"),
    ("03/04/2021 13:55", "Europe/Berlin", "2021-04-03T11:55:00.000000Z"),
    ("03/14/2021 02:33:49 AM", "America/Los_Angeles", "2021-03-14T10:33:49.000000Z"),  # skipped: offset before the change
    ("2021-11-07 01:30:00", "America/New_York", "2021-11-07T05:30:00.000000Z"),  # twice: the first
    ("Apr 12, 2024 12:35:03 AM PDT", None, "2024-04-12T07:35:03.000000Z"),
    ("1 de marzo de 2023", None, "2023-03-01"), ("16. März 2020", None, "2020-03-16"), ("27 août 2022", None, "2022-08-27"), ("2020年2月11日", None, "2020-02-11"),
    ("April 3rd, 2022", None, "2022-04-03"), ("02-OCT-2004", None, "2004-10-02"), ("05.07.23", None, "2023-07-05"), ("20200618", None, "2020-06-18"),
    ("20240911T012055Z", None, "2024-09-11T01:20:55.000000Z"), ("1578087604", "Asia/Tokyo", "2020-01-03T21:40:04.000000Z"), ("1580090118063", None, "2020-01-27T01:55:18.063000Z"),
    ("12 July 2023, 07:11 UTC+5:30", None, "2023-07-12T01:41:00.000000Z"), ("2020-06-01T02:16:10+02:00[Europe/Berlin]", None, "2020-06-01T00:16:10.000000Z"),
    ("2024-13-05", None, None), ("31.11.2022", None, None), ("0000-00-00", None, None), ("Q3 2024", None, None), ("2021-01-01 25:00", None, None), ("soon™", None, None),
    ("", None, None), (None, None, None), ("2021-01-01 10:00 XYZ", None, None), ("2021-01-01 10:00", "No/Zone", None), ("9" * 5000, None, None),
]


def test_normal_forms():
    got = instants.normal_forms(pd.Series([c[0] for c in CASES], dtype=object), pd.Series([c[1] for c in CASES], dtype=object))
    assert [None if g is None else g for g in got] == [c[2] for c in CASES]


@settings(max_examples=80, deadline=None)
@given(st.datetimes(datetime.datetime(1990, 1, 1), datetime.datetime(2036, 1, 1)), st.sampled_from(["America/New_York", "Australia/Sydney", "Asia/Kolkata", "Europe/London", "Pacific/Chatham"]))
def test_zone_tables_agree_with_the_library(moment, zone):
    from zoneinfo import ZoneInfo

    local = moment.replace(microsecond=0, tzinfo=ZoneInfo(zone), fold=0)
    want = local.astimezone(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    got = instants.normal_forms(pd.Series([local.strftime("%Y-%m-%d %H:%M:%S")]), pd.Series([zone]))
    assert got[0] == want


def test_normalise_timestamps(spark, rows):
    df = spark.createDataFrame([(1, "2020-01-01", None, "UTC", "x"), (2, None, "no day", None, "x"), (1, "2020-01-01", None, "UTC", "x")], "row_id int, a string, b string, z string, value string")
    assert rows(normalise_timestamps(df, "row_id", ["a", "b"], "z")) == [(1, "a", "2020-01-01")] * 2
    assert normalise_timestamps(df.limit(0), "row_id", ["a"], "z").count() == 0


# --- profiles
def test_ill_formed_values(spark):
    good = ["Lanternfold Interactive", "N.A. Quill Forge", "None More Bright", "404 Kites", "Élan Mirovel", "星霧工房", "K・V・M Studio", "O'Dremmel & Sons", "A5", None]
    bad = ["", " ", "6006", "N/A", "null", "#REF!", " Pad", "Pad\t", "Nan�elxa", "Zad\x07eware", "StudÃ\xado", "Ã‰lan", "â€œReklem", "<b>X</b>", "A&nbsp;B", "info@x.example", "https://x.example/a", "***", "(?)"]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", ill_formed_name(F.col("v")).alias("b"))
    assert [r["v"] for r in df.collect() if r["b"]] == bad
    days = ["2020-01-15", None, "2020-1-15", "2020-02-30", "1989-12-31", "2027-01-01", "2020-01-15 ", "2020-01-15\n", "20200115", ""]
    df = spark.createDataFrame([(v,) for v in days], "v string").select("v", ill_formed_day()(F.col("v")).alias("b"))
    assert [r["v"] for r in df.collect() if r["b"]] == days[2:]


def test_shift_is_decided_exactly(spark):
    # 10 rows a load: one row moved is a distance of exactly 0.10
    data = [(1, i, "a") for i in range(10)] + [(3, 10 + i, "a") for i in range(9)] + [(3, 20, "b")] + [(4, 30 + i, "a") for i in range(19)] + [(4, 60, "b")]
    df = spark.createDataFrame(data, "load int, row_id int, p string")
    rule = {"p": lambda c: c.isNull() & c.isNotNull()}
    assert [(r["load"], r["row_id"]) for r in quality_findings(df, "load", "row_id", rule).collect()] == [(3, 0)]
    s = {r["load"]: r for r in load_shifts(df, "load", rule).collect()}
    assert abs(s[3]["half_sum"] - 0.1) < 1e-12 and abs(s[4]["half_sum"] - 0.05) < 1e-12 and s[3]["psi"] > 0


def test_profile_and_findings_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, " x"), (None, 3, "y")], "load int, row_id int, p string")
    p = {r["load"]: r for r in profile_columns(df, "load", {"p": ill_formed_name}).collect()}
    assert (p[1]["n_rows"], p[1]["n_null"], p[1]["n_ill_formed"], p[1]["n_distinct"]) == (2, 1, 1, 1) and p[None]["n_rows"] == 1
    assert [tuple(r) for r in quality_findings(df, "load", "row_id", {"p": ill_formed_name}).collect()] == [("value", 1, "p", 2)]
    assert quality_findings(df.limit(0), "load", "row_id", {"p": ill_formed_name}).count() == 0


def test_stand_ins_agree_in_both_languages(spark):
    values = ["N/A", "unknown", " - ", "", None, "Active", "Free", "#N/A", "TBA", "soon™", "None More", "0", "…"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(is_stand_in(F.col("v"))).collect()]
    assert got == [stands_for_missing(v) for v in values]


# --- two copies
def brute_differences(a, b, columns):
    out = []
    for k in sorted(a.keys() | b.keys()):
        if k not in b:
            out.append((k, "only_in_left"))
        elif k not in a:
            out.append((k, "only_in_right"))
        else:
            out += [(k, c) for i, c in enumerate(columns) if (a[k][i] or "").strip() != (b[k][i] or "").strip()]
    return out


@pytest.mark.parametrize("changed", [0.0, 0.02, 0.9])
def test_reconcile(spark, rows, changed):
    r = random.Random(5)
    a = {k: (f"t{k}", r.choice([None, "", "p"])) for k in range(6000)}
    b = {k: (v[0] + ("!" if r.random() < changed else " "), v[1]) for k, v in a.items() if r.random() > changed / 4} | {-1: ("new", None)}
    frame = lambda d: spark.createDataFrame([(k, *v, 1) for k, v in d.items()], "id bigint, title string, publisher string, _key int")
    got = rows(reconcile.reconcile(frame(a), frame(b), "id", ["title", "publisher"]))
    assert got == sorted(brute_differences(a, b, ["title", "publisher"]))


def entry_frame(spark, keys):
    return spark.createDataFrame([(k, hash((k, "row")) & (1 << 62) - 1) for k in keys], "_key bigint, _row bigint")


def test_hashes_are_those_of_spark(spark):
    df = spark.createDataFrame([(k, r) for k, r in [(0, 0), (1, -1), (-5, 7), (1 << 62, -(1 << 63)), (123456789, 987654321)]], "_key bigint, _row bigint")
    for name in ("check", 0, 1, 2):
        assert all(r[2] == reconcile.of_entry(name, r[0], r[1]) for r in df.select("_key", "_row", reconcile._of_entry(name)).collect())


@pytest.mark.parametrize("n", [0, 1, 100, 512, 640, 800])
def test_a_table_gives_all_its_entries(spark, n):
    """Up to the room of a table, and to a quarter more, every random table peels; nothing falls back to rows."""
    r = random.Random(n)
    third = reconcile.THIRD
    for _ in range(20):
        entries = {(r.getrandbits(63), r.getrandbits(63) - (1 << 62)) for _ in range(n)}
        cells: dict = {}
        for k, v in entries:
            for j in range(3):
                c = cells.setdefault(reconcile.of_entry(j, k, v) % third + j * third, [0, 0, 0, 0])
                sign = 1 if k % 3 else -1
                cells[reconcile.of_entry(j, k, v) % third + j * third] = [c[0] + sign, c[1] ^ k, c[2] ^ v, c[3] ^ reconcile.of_entry("check", k, v)]
        assert set(reconcile.peel([(c, *s) for c, s in cells.items()], third)) == entries


def test_tables_are_sized_by_differences(spark):
    left, right = entry_frame(spark, range(20_000)), entry_frame(spark, range(800, 20_000))
    both = left.withColumn("_sign", F.lit(1).cast("long")).unionByName(right.withColumn("_sign", F.lit(-1).cast("long")))
    assert 400 <= reconcile.estimated_differences(both) <= 1600
    few = both.where("_key < 840 or _key % 7 = 0")
    assert 400 <= reconcile.estimated_differences(few) <= 1600
    assert reconcile.estimated_differences(both.where("_key >= 800")) == 0 and reconcile.estimated_differences(both.where("_key > 780")) == 19
    assert {r[0] for r in reconcile.differing_keys(left, right).collect()} == set(range(800))


def test_a_full_table_is_compared_row_by_row(spark, rows):
    left, right = entry_frame(spark, range(5000)), entry_frame(spark, range(10, 4000))
    assert {r[0] for r in reconcile.differing_keys(left, right, differences=1).collect()} == {*range(10), *range(4000, 5000)}
    left = spark.range(5000).select("id", F.lit("a").alias("t"))
    assert reconcile.reconcile(left, left.limit(0), "id", ["t"]).count() == 5000
    assert reconcile.reconcile(left.limit(0), left.limit(0), "id", ["t"]).count() == 0


def test_reconcile_takes_the_latest_row_and_decides_ties(spark, rows):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "p", 1), (2, "q", 1), (3, "s", None), (None, "n", 1)], "id bigint, t string, at int")
    b = spark.createDataFrame([(1, " y ", 7), (2, "q", 7), (2, "q ", 7), (3, "s", 1), (3, "old", None)], "id bigint, t string, at int")
    assert rows(reconcile.reconcile(a, b, "id", ["t"], recent="at")) == [(2, "t")]
    assert rows(reconcile.reconcile(a, b, "id", ["t"], recent="at", left_ties=[F.col("t").desc()])) == []


def test_days_written_differently_are_equal(spark):
    same = ["2020-01-05", "20200105", "2020/1/5", "2020-01-05 00:00:00", "2020-01-05T00:00:00Z", " 2020-01-05\t"]
    other = ["2020-01-05 10:00:00", "2020-02-30", "05.01.2020", "", None, "20201305"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in same + other], "v string").select(day_or_text(F.col("v"))).collect()]
    assert got == ["2020-01-05"] * len(same) + ["2020-01-05 10:00:00", "2020-02-30", "05.01.2020", None, None, "20201305"]


# --- snapshots
def test_snapshot_changes(spark, rows):
    r = random.Random(7)
    state, data, want, row = {k: "a" for k in r.sample(range(20_000), 3000)}, [], [], 0
    before = None
    for load in (1, 2, 5):
        for k, v in state.items():
            data.append((row, load, k, f" {v} ", 10))
            row += 1
        for k in r.sample(sorted(state), 50):  # an older sending of another text does not hold
            data.append((row, load, k, "old", 5))
            row += 1
        data.append((row, load, None, "nobody", 1))
        row += 1
        if before is not None:
            want += [(load, k, "removed" if k not in state else "added" if k not in before else "changed") for k in before.keys() | state.keys() if before.get(k) != state.get(k)]
        before, state = state, dict(state)
        for k in r.sample(sorted(state), 40):
            del state[k]
        for k in r.sample(sorted(state), 40):
            state[k] += "x"
        for k in r.sample(range(20_000, 30_000), 40):
            state[k] = "n"
    df = spark.createDataFrame(data, "row_id int, load int, id bigint, t string, at int")
    order = ["at", "row_id"]
    assert rows(snapshots.snapshot_changes(df, "load", "id", ["t"], order)) == sorted(want)
    assert snapshots.snapshot_changes(df.where("load = 1"), "load", "id", ["t"], order).count() == 0
    assert snapshots.snapshot_changes(df.limit(0), "load", "id", ["t"], order).count() == 0


def test_snapshot_edges(spark, rows):
    df = spark.createDataFrame([(1, 1, 7, None), (2, 1, 7, None), (3, 2, 7, "  "), (4, 2, -8, "x")], "row_id int, load int, id bigint, t string")
    assert rows(snapshots.snapshot_changes(df, "load", "id", ["t"], ["row_id"])) == [(2, -8, "added")]
    assert latest_per_key(df, ["id"], [F.col("row_id")]).count() == 2
