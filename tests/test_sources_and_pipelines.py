"""Readers, writers and the three pipelines end to end on temporary folders."""

import http.server
import json
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.errors import SampleError, SourceError, StoreError
from millrace.operators import sample
from millrace.plans import clean, contracts, enrich, ingest
from millrace.sources import fetch, files, records, sinks, sqlite
from millrace.streaming.upserts import read_upserted, upsert_batch, upsert_stream

GAMES = [
    {"id": 1, "title": "  Alpha  ", "thumbnail": "t", "short_description": "Ñandú", "game_url": "u", "genre": "RPG ", "platform": "PC", "publisher": "P", "developer": "D", "release_date": "2020-01-15", "freetogame_profile_url": "f", "new": 1},
    {"id": 2, "title": "Beta", "thumbnail": None, "short_description": "", "genre": "MOBA", "platform": "PC  ", "publisher": None, "developer": "D", "release_date": "soon"},
    {"id": 3, "title": "Gamma", "genre": "RPG", "release_date": "2021-02-03"},
    {"id": 3, "title": "Gamma again", "genre": "RPG", "release_date": "2021-02-03"},
    {"id": None, "title": "Nobody"},
    {"id": 5, "title": None},
]
OFFERS = {"giveaways": [{"id": 10, "title": "Alpha (Steam) Giveaway", "worth": "$1.00", "published_date": "2020-01-01 10:00:00", "users": 5}, {"id": 11, "title": "alpha (GOG)", "worth": "$2.00", "published_date": "2021-01-01 10:00:00", "users": None}, {"id": 12, "title": "(Steam)", "worth": "N/A", "published_date": "N/A"}]}
CONTRAST = [{"id": 20, "title": "Bravo", "genre": "moba", "platform": "PC", "publisher": "X", "developer": "d"}]


def write(path, data):
    path.write_text(json.dumps(data), encoding="utf-8")
    return str(path)


def test_json_documents(spark, tmp_path):
    plain, wrapped = write(tmp_path / "a.json", GAMES), write(tmp_path / "o.json", OFFERS)
    assert files.read_json_records(spark, plain, contracts.CATALOGUE).count() == 6
    got = files.read_json_records(spark, wrapped, contracts.OFFERS, "giveaways")
    assert got.count() == 3 and dict(got.dtypes)["users"] == "bigint"
    assert files.field_drift(spark, plain, contracts.CATALOGUE)[1] == ["new"]
    for bad in ([], {"other": []}, {"giveaways": []}):
        with pytest.raises(SourceError):
            files.read_json_records(spark, write(tmp_path / "bad.json", bad), contracts.OFFERS, "giveaways")
    (tmp_path / "x.json").write_text("<html>")
    with pytest.raises(SourceError):
        files.read_json_records(spark, str(tmp_path / "x.json"), contracts.OFFERS)
    with pytest.raises(SourceError):
        files.read_json_records(spark, wrapped, contracts.OFFERS)


def test_csv_and_mapping(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc'), (2, None), (3, "NA"), (4, ""), (5, " x ")], "id bigint, title string")
    sinks.write_csv(df, str(tmp_path / "x" / "a.csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "x" / "a.csv"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert files.read_mapping(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "m.csv").write_text("target_title,offers_title\n")
    with pytest.raises(SourceError):
        files.read_mapping(spark, str(tmp_path / "m.csv"))


def test_fetch(tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(500 if self.path == "/bad" else 200)
            self.end_headers()
            self.wfile.write(b"no json" if self.path == "/text" else b"[1]")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    get = fetch.http_fetcher(5)
    assert fetch.land(f"{at}/ok", str(tmp_path / "r" / "ok.json"), get) and (tmp_path / "r" / "ok.json").read_bytes() == b"[1]"
    with pytest.raises(SourceError):
        get(f"{at}/bad")
    with pytest.raises(SourceError):
        fetch.land(f"{at}/text", str(tmp_path / "t.json"), get)
    assert (tmp_path / "t.json").exists()  # landed before it was looked at
    server.shutdown()
    server.server_close()
    with pytest.raises(SourceError):
        get(f"{at}/ok")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "d" / "g.db")
    df = spark.createDataFrame([(i, f"t{i}" if i % 3 else None) for i in range(50)] + [(None, "x")], "id bigint, title string")
    assert sqlite.write_sqlite(df, path, "games", "id") == 50
    sqlite.write_sqlite(df.where("id = 1").withColumn("title", F.lit("new")), path, "games", "id")
    got = sqlite.read_sqlite(spark, path, "games")
    assert got.count() == 50 and got.where("id = 1").first()["title"] == "new" and got.where("title is null").count() == 17
    assert sqlite.read_sqlite(spark, path, "games", "title string").columns == ["title"]
    for args in ((str(tmp_path / "no.db"), "games"), (path, "absent")):
        with pytest.raises(StoreError):
            sqlite.read_sqlite(spark, *args)


def test_snapshot_survives_a_stop_at_every_step(spark, tmp_path, monkeypatch):
    """Whatever step a writer stops at, a reader has the old table or the new one, and the next writer goes on."""
    path = str(tmp_path / "t")
    seen = lambda: [r[0] for r in sinks.read_snapshot(spark, path).collect()]
    assert sinks.read_snapshot(spark, path) is None
    for n in (1, 2, 3):
        sinks.swap_snapshot(spark.range(n, n + 1), path)
    assert seen() == [3]

    class Stop(BaseException):
        """As if the process were killed: no handler runs."""

    def stop(*_):
        raise Stop

    for step, left in (("complete", [3]), ("remove", [5])):
        with monkeypatch.context() as m, pytest.raises(Stop):
            m.setattr(sinks, step, stop)
            sinks.swap_snapshot(spark.range(5, 6), path)
        assert seen() == left
    with pytest.raises(StoreError):
        sinks.swap_snapshot(spark.range(7).select(F.raise_error(F.lit("no"))), path)
    assert seen() == [5]
    sinks.swap_snapshot(sinks.read_snapshot(spark, path).select(F.col("id") + 1), path)
    sinks.swap_snapshot(sinks.read_snapshot(spark, path).select(F.col("(id + 1)") + 1), path)
    assert seen() == [7] and len(sinks.versions(spark, path)[0]) == 2 and not sinks.versions(spark, path)[1]


def test_stream_upsert(spark, tmp_path):
    names = "k bigint, v string, _n bigint"
    at = str(tmp_path / "t")

    def send(rows):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_stream(spark.readStream.schema(names).parquet(str(tmp_path / "in")), at, "k", ["_n"], str(tmp_path / "c"), parts=4).awaitTermination()
        return sorted(tuple(r) for r in read_upserted(spark, at).collect())

    assert send([(1, "a", 1), (1, "b", 5), (2, "c", 1), (None, "x", 1)]) == [(1, "b"), (2, "c")]
    assert send([(2, "d", 1), (3, "e", 1), (1, "late", 3)]) == [(1, "b"), (2, "d"), (3, "e")]  # a late row does not replace a newer one
    again = spark.createDataFrame([(2, "d", 1), (3, "e", 1)], names)
    for _ in range(3):
        upsert_batch(again, at, "k", ["_n"], 4)
    assert sorted(tuple(r) for r in read_upserted(spark, at).collect()) == [(1, "b"), (2, "d"), (3, "e")]
    upsert_batch(again.limit(0), at, "k", ["_n"], 4)


def test_pipelines(spark, tmp_path):
    get = fetch.file_fetcher()
    lake, out = str(tmp_path / "lake"), str(tmp_path / "out")
    source = write(tmp_path / "games.json", GAMES)
    first = ingest.run(spark, source, lake, get)
    assert (first.code, first.stored, first.rejected) == (0, 3, 2)
    assert ingest.run(spark, source, lake, get).stored == 3  # again: the same
    assert "complete" in (tmp_path / "lake" / "report" / "audit.txt").read_text()
    assert ingest.run(spark, str(tmp_path / "none.json"), lake, get).code == 1
    assert sinks.read_snapshot(spark, lake + "/store").where("id = 3").first()["title"] == "Gamma again"

    done = clean.run(spark, lake + "/store", out)
    assert (done.code, done.rows, done.score) == (0, 3, 100.0)
    rows = {r["id"]: r for r in sinks.read_snapshot(spark, out + "/clean").collect()}
    assert rows[1]["title"] == "Alpha" and rows[1]["release_year"] == 2020 and rows[2]["release_date"] is None
    assert rows[2]["publisher"] == "Unknown" and rows[2]["short_description"] == "Not Available"
    assert clean.run(spark, str(tmp_path / "nowhere"), out).code == 1

    (tmp_path / "map.csv").write_text("target_title,offers_title,contrast_title,method\nBeta,,Bravo,manual\n", encoding="utf-8")
    got = enrich.run(spark, out + "/clean", out, write(tmp_path / "o.json", OFFERS), write(tmp_path / "c.json", CONTRAST), str(tmp_path / "map.csv"), get)
    assert (got.code, got.rows, got.offers_matched, got.contrast_matched) == (0, 3, 1, 1)
    final = {r["id"]: r for r in sinks.read_snapshot(spark, out + "/enriched").collect()}
    assert len(final[1].asDict()) == 33 and final[1]["gamerpower_id"] == 11 and final[1]["genre_match"] is None
    assert final[2]["mmobomb_id"] == 20 and final[2]["genre_match"] is True and final[2]["publisher_match"] is False
    assert "lineage" in (tmp_path / "out" / "report" / "enrichment.txt").read_text().lower()
    assert enrich.run(spark, str(tmp_path / "nowhere"), out, "", "", "", get).code == 1


def test_records_and_pandas(spark):
    schema = "id bigint, title string, at date"
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema)
    got = records.from_records(spark, [{"id": 1, "title": "a", "new": 5}, {"title": None}], schema)
    assert [tuple(r) for r in got.collect()] == [(1, "a", None), (None, None, None)]
    with pytest.raises(SourceError):
        records.from_records(spark, [{"id": "one"}], schema)
    table = pd.DataFrame({"title": ["a", None, float("nan")], "id": [1, None, 3]})
    assert [tuple(r) for r in records.from_pandas(spark, table, schema).collect()] == [(1, "a", None), (None, None, None), (3, None, None)]
    assert records.from_pandas(spark, table.iloc[:0], schema).count() == 0


def test_samples(spark, tmp_path):
    df = spark.range(30).select(F.col("id"), F.lit(" x ").alias("t"))
    got = sample.write_sample(df, "id", str(tmp_path / "s.csv"), 5)
    assert (got.asked, got.of, got.rows) == (5, 30, 5) and (tmp_path / "s.csv").read_text().count("\n") == 6
    for frame, n in ((df.limit(0), 5), (df, 0)):
        with pytest.raises(SampleError):
            sample.write_sample(frame, "id", str(tmp_path / "e.csv"), n)


def test_other_entries_to_the_pipelines(spark, tmp_path):
    """Cleaning starts from SQLite, enrichment from CSV; issues, summaries and errors come out."""
    get = fetch.file_fetcher()
    rows = [{k: g.get(k) for k in contracts.CATALOGUE_FIELDS} for g in GAMES if g["id"] and g["title"]]
    store = str(tmp_path / "g.db")
    sqlite.write_sqlite(records.from_records(spark, rows, contracts.CATALOGUE).dropDuplicates(["id"]), store, clean.SQLITE_TABLE, "id")
    assert sorted(r[0] for r in sqlite.sqlite_keys(spark, store, clean.SQLITE_TABLE, "id").collect()) == [1, 2, 3]
    out = str(tmp_path / "out")
    assert (clean.run(spark, store, out).code, clean.run(spark, str(tmp_path / "no.db"), out).code) == (0, 1)
    sinks.write_csv(sinks.read_snapshot(spark, out + "/clean"), str(tmp_path / "base.csv"))
    offers, contrast = write(tmp_path / "o.json", OFFERS), write(tmp_path / "c.json", CONTRAST)
    got = enrich.run(spark, str(tmp_path / "base.csv"), out, offers, contrast, str(tmp_path / "none.csv"), get)
    assert (got.code, got.rows, got.issues) == (0, 3, ())
    of = got.sources[0]
    assert (of.records, of.unique_keys, of.duplicate_keys, of.surplus_rows, of.without_key, of.matched, of.unmatched) == (3, 1, 1, 1, 1, 1, 2)
    text = (tmp_path / "out" / "report" / "enrichment.txt").read_text().lower()
    assert "issues" in text and "duplicate_keys" in text
    twice = sinks.read_snapshot(spark, out + "/clean")
    sinks.swap_snapshot(twice.unionByName(twice.where("id = 1")), str(tmp_path / "twice"))
    got = enrich.run(spark, str(tmp_path / "twice"), out, offers, contrast, str(tmp_path / "none.csv"), get)
    assert got.code == 2 and "the base has 1 duplicate keys" in got.issues
    for bad in ("id,genre\n1,x\n", "id,title\n"):
        (tmp_path / "bad.csv").write_text(bad)
        assert enrich.run(spark, str(tmp_path / "bad.csv"), out, offers, contrast, str(tmp_path / "none.csv"), get).code == 1
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    assert clean.run(spark, str(tmp_path / "broken"), out).code == 1  # an error of Spark's own


def test_command_line(spark, tmp_path):
    from millrace.plans.cli import main

    source = write(tmp_path / "games.json", GAMES)
    assert main(["ingest", source, str(tmp_path / "lake"), "--files"]) == 0
    assert main(["clean", str(tmp_path / "lake" / "store"), str(tmp_path / "out")]) == 0
    assert main(["clean", str(tmp_path / "nowhere"), str(tmp_path / "out")]) == 1
    with pytest.raises(SystemExit):
        main(["unknown"])
