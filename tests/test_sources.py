import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kinweave.operators import evaluate
from kinweave.operators.store import Store
from kinweave.sources import readers
from kinweave.streaming import watch


def test_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><link>http://a/1</link><description><![CDATA[<p>Body</p>]]></description><pubDate>Mon, 08 Sep 2026 14:30:00 GMT</pubDate></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed><entry><title>U</title><link href="http://b/1"/><summary>Sum</summary><updated>2026-09-08T14:30:00Z</updated></entry></feed>')
    got = {r.source_ref: (r.text, r.published_at) for r in readers.feed(spark, str(tmp_path)).collect()}
    at = dt.datetime(2026, 9, 8, 14, 30)
    assert got == {"http://a/1": ("T\n\nBody", at), "http://b/1": ("U\n\nSum", at)}


def test_quakes(spark, tmp_path):
    feature = lambda mag, kind, at: {"id": "x", "properties": {"mag": mag, "type": kind, "time": 0}, "geometry": {"coordinates": at}}
    (tmp_path / "q.json").write_text(json.dumps({"features": [feature(6.5, "earthquake", [1.0, 2.0, 3.0]), feature(None, "explosion", [1.0, 2.0]), feature(2.0, None, [1.0, 2.0]), feature(9.0, "earthquake", [1.0])]}))
    q = readers.quakes(spark, str(tmp_path / "q.json"))
    assert q.count() == 3 and {r.event_type for r in readers.quake_escalations(q).collect()} == {"earthquake", "explosion"} and q.where("depth_km = 0").count() == 2


def test_gazetteer_and_geocoding(spark, tmp_path):
    row = lambda i, name, alt, country, code, pop: "\t".join([str(i), name, name, alt, "1.5", "2.5", "P", code, country, "", "", "", "", "", str(pop)])
    (tmp_path / "c.txt").write_text("\n".join([row(1, "Paris", "Lutetia", "FR", "PPLC", 2_000_000), row(2, "Paris", "", "US", "PPL", 20_000), row(3, "Lyon", "", "FR", "PPL", 500_000), "bad\trow"]))
    (tmp_path / "k.txt").write_text("# head\nFR\tFRA\t250\tFR\tFrance\tParis\n")
    places, names, countries = readers.gazetteer(spark, str(tmp_path / "c.txt"), str(tmp_path / "k.txt"))
    e = spark.createDataFrame([("a", "location", "France", [], True), ("b", "location", "Paris", [], True), ("c", "location", "Lyon, somewhere", ["Lutetia"], True), ("d", "person", "Lyon", [], True), ("e", "location", "Nowhere", [], True)], "entity_id string, entity_type string, canonical_name string, aliases array<string>, is_live boolean")
    got = {r.entity_id: (r.geonameid, r.confidence) for r in evaluate.geocode(e, places, names, countries).collect()}
    assert got == {"a": (1, 0.9), "b": (1, 0.6), "c": (1, 0.8)}


def test_mission(tmp_path):
    (tmp_path / "m.toml").write_text('name = "x"\nquestions = ["who?"]\n')
    assert readers.mission(str(tmp_path / "m.toml"))["rss"] == [] and readers.mission(str(tmp_path / "m.toml"))["questions"] == ["who?"]


def test_watch_ingests_once(spark, tmp_path):
    land, root = tmp_path / "land", tmp_path / "store"
    land.mkdir()
    item = {"source_type": "rss", "source_ref": "r", "title": "t", "text": "Mistral AI raised funds in Paris.", "license_class": "unknown", "published_at": "2026-01-01T00:00:00Z"}
    now = F.lit(dt.datetime(2026, 2, 2))
    for name in ("1.json", "2.json"):
        (land / name).write_text(json.dumps(item) + "\n" + json.dumps(item | {"source_ref": name, "text": "Mistral spoke with Nvidia.", "published_at": "2026-02-01T00:00:00Z"}) + "\n")
        watch.watch(spark, str(land), str(root), now).awaitTermination()
    s = Store(spark, str(root))
    assert s.read("items").count() == 3 and {r.canonical_name for r in s.read("entities").collect()} == {"Mistral AI", "Paris", "Nvidia"}


def test_a_batch_that_broke_off_starts_over(spark, tmp_path, monkeypatch):
    now = F.lit(dt.datetime(2026, 2, 2))
    rows = [("rss", f"r{i}", "t", text, "unknown", dt.datetime(2026, 1, 1 + i)) for i, text in enumerate(["Mistral AI raised funds in Paris.", "Mistral AI spoke with Nvidia in Paris."])]
    batch = spark.createDataFrame(rows, watch.RAW)
    s = Store(spark, str(tmp_path / "store"))
    write = Store.write

    def broken(self, table, frame, version=None):
        if table == "edges":
            raise OSError("lost")
        return write(self, table, frame, version)

    monkeypatch.setattr(Store, "write", broken)
    with pytest.raises(OSError):
        watch.cycle(s, batch, 0, now)
    assert s.committed() is None and s.versions("entities") == [1] and s.versions("items") == []
    monkeypatch.setattr(Store, "write", write)
    watch.cycle(s, batch, 0, now)
    watch.cycle(s, batch, 0, now)
    assert s.committed() == 1 and s.read("items").count() == 2 and {r.canonical_name for r in s.read("entities").collect()} == {"Mistral AI", "Paris", "Nvidia"}
    assert s.read("edges").count() >= 1 and {r.status for r in s.read("items").collect()} <= {"needs_llm", "resolved"}
    weight = s.read("edges").agg(F.sum("weight")).first()[0]
    watch.cycle(s, spark.createDataFrame([("rss", "r9", "t", "Nvidia met Mistral AI in Paris.", "unknown", dt.datetime(2026, 1, 9))], watch.RAW), 1, now)
    assert s.committed() == 2 and s.read("items").count() == 3 and s.read("edges").agg(F.sum("weight")).first()[0] > weight
