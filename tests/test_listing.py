import datetime as dt
import json

from pyspark.sql import functions as F

from kinweave.operators import enrich, evaluate, listing, resolve, state

NOW = dt.datetime(2026, 9, 10)
ENTITY = "entity_id string, entity_type string, canonical_name string, confidence double"


def entities(spark, rows):
    return state.create_entities(spark.createDataFrame(rows, ENTITY), F.lit(NOW))


def candidates(spark, rows):
    return spark.createDataFrame(rows, "candidate_id string, item_id string, mention_text string, entity_id string, match_score double, status string, observed_at timestamp")


def items(spark, rows):
    return spark.createDataFrame([(i, i, t, NOW, NOW) for i, t in rows], "item_id string, source_ref string, raw_text string, published_at timestamp, ingested_at timestamp")


def test_search_and_lists(spark):
    e = entities(spark, [("a", "organization", "Globex Robotics", 0.9), ("b", "person", "Jane Globex", 0.8), ("c", "location", "Paris", 0.8), ("d", "location", "Lyon", 0.7)])
    got = [(r.entity_id, r.hits) for r in listing.search_entities(e, "globex robotics", phonetics=False).orderBy(F.col("hits").desc()).collect()]
    assert got[0] == ("a", 3) and got[1][0] == "b" and len(got) == 2
    assert listing.search_entities(e, "  ").count() == 0
    c = candidates(spark, [("1", "i", "Paris", "c", 5.0, "auto_merged", NOW), ("2", "j", "Paris", "c", 5.0, "resolved", NOW), ("3", "j", "Lyon", "d", 5.0, "confirmed", NOW), ("4", "k", "Lyon", "d", 1.0, "pending_review", NOW)])
    assert [(r.entity_id, r.n) for r in listing.top_corroborated(e, c).collect()] == [("c", 2), ("d", 1)]
    geo = spark.createDataFrame([("c", 1)], "entity_id string, geonameid int")
    assert [r.entity_id for r in listing.ungeocoded(e, geo).collect()] == ["d"] and listing.ungeocoded(e, None).count() == 2
    assert sorted(tuple(r) for r in listing.upsert_geo(geo, spark.createDataFrame([("c", 2), ("d", 3)], geo.schema)).collect()) == [("c", 2), ("d", 3)]
    late = candidates(spark, [("1", "i", "Paris", None, None, "needs_llm", NOW), ("2", "i", "Paris", "c", 6.0, "auto_merged", NOW + dt.timedelta(1))])
    assert [(r.source_ref, r.status, r.entity_id) for r in listing.latest_states(late, items(spark, [("i", "x")])).collect()] == [("i", "auto_merged", "c")]


def test_strongest_mentions_and_breakdown(spark):
    m = spark.createDataFrame([("i", "Acme", 5, 0.5), ("i", "ACME", 9, 0.9), ("i", "acme", 20, 0.9), ("j", "Acme", 1, 0.1)], "item_id string, mention_text string, start int, score double")
    assert sorted((r.item_id, r.start) for r in listing.strongest_mentions(m).collect()) == [("i", 9), ("j", 1)]
    x = spark.range(1).select(listing.breakdown(F.array(F.struct(F.lit("name_jw").alias("name"), F.lit(4.5).alias("weight")), F.struct(F.lit("phonetic").alias("name"), F.lit(-0.25).alias("weight")))).alias("x")).first().x
    assert x in ("name_jw +4.5, phonetic -0.3", "name_jw +4.5, phonetic -0.2")


def test_graph_rows_and_brief(spark):
    e = entities(spark, [("a", "organization", "Globex", 0.9), ("b", "person", "Jane Doe", 0.8)])
    v = spark.createDataFrame([("x", "b", "a", "ceo_of", 2.0, ["i"], NOW, None), ("y", "a", "b", "mentioned_with", 1.0, ["i"], NOW, NOW)], "edge_id string, from_id string, to_id string, edge_type string, weight double, source_item_ids array<string>, valid_at timestamp, invalid_at timestamp")
    rows = {r.id: json.loads(r.json) for r in listing.graph_rows(e, v).collect()}
    assert set(rows) == {"a", "b", "x"} and rows["x"]["from"] == "b" and rows["a"]["name"] == "Globex"
    c = candidates(spark, [("1", "i", "Globex", "a", 5.0, "auto_merged", NOW)])
    text = listing.brief("watch", [("Who leads Globex?", "Jane Doe [1]")], e, v, c, items(spark, [("i", "x")]))
    assert "1 items; 2 live entities; 1 valid relations (1 typed)" in text and "- Jane Doe ceo_of Globex (2)" in text and "- Globex (organization): 1" in text


def test_report_and_tokens(spark):
    df = spark.createDataFrame([(6.0, True), (2.0, False), (0.0, False), (7.0, False)], "total double, is_match boolean")
    text = evaluate.report(df)
    assert "review rate: 25.0%" in text and "| merge (total >= 5) | 0.500 | 1.000 | 0.667 | 2 |" in text and text.count("\n| ") >= 27
    none = spark.createDataFrame([], "token_id string, token_hash string, name string, role string, ask_daily_limit long, license_filter string, created_at timestamp, revoked_at timestamp")
    plain = state.generate_token()
    assert len(plain) == 36 and plain != state.generate_token()
    t = state.create_token(none, plain, "n", "analyst", F.lit(NOW), 3)
    asked = spark.createDataFrame([(plain,), ("other",)], "bearer string")
    assert {r.bearer: r.role for r in state.authenticate(asked, t).collect()} == {plain: "analyst", "other": None}
    gone = state.revoke_token(t, t.first().token_id, F.lit(NOW))
    assert {r.role for r in state.authenticate(asked, gone).collect()} == {None} and plain not in str(t.first())
    assert listing.whoami(listing.open_principal() | {"token_hash": "x"})["role"] == "operator" and "token_hash" not in listing.whoami({"token_hash": "x"})


def test_canonical_names_that_are_other_things_give_way(spark):
    rows = spark.createDataFrame([("Globex Corp", "Globex Corporation", "organization"), ("Globex", "Initech Labs", "organization"), ("ACME", "acme ", "organization")], "mention string, canonical_name string, entity_type string")
    assert {r.mention: r.canonical for r in enrich.sane_canonical(rows).collect()} == {"Globex Corp": "Globex Corporation", "Globex": "Globex", "ACME": "acme "}


def test_answers_become_entities_and_relations(spark):
    e = entities(spark, [("g", "unknown", "Globex Robotics", 0.5)])
    it = items(spark, [("i", "Jane Doe is the CEO of Globex Robotics, a maker of arms."), ("j", "Nothing here."), ("k", "Jane Doe again.")])
    c = candidates(spark, [("1", "i", "Jane Doe", None, None, "needs_llm", NOW), ("2", "i", "Globex Robotics", "g", 6.0, "auto_merged", NOW), ("3", "j", "Nothing", None, None, "needs_llm", NOW)])
    assert [r.item_id for r in enrich.waiting(c, 10).collect()] == ["i", "j"]
    said = {"entities": [{"mention": "Jane Doe", "canonical_name": "Jane Doe", "entity_type": "person", "confidence": 0.9}, {"mention": "Globex Robotics", "canonical_name": "Globex Robotics", "entity_type": "organization", "confidence": 0.8}, {"mention": "Initech", "canonical_name": "Initech", "entity_type": "organization", "confidence": 0.9}], "relations": [{"a": "Jane Doe", "b": "Globex Robotics", "relation_type": "ceo_of"}, {"a": "Globex Robotics", "b": "Jane Doe", "relation_type": "acquired"}]}
    answers = spark.createDataFrame([("i", "Sure: " + json.dumps(said)), ("j", "no object")], "item_id string, answer string")
    got = enrich.apply_answers(answers, it, e, c, F.lit(NOW))
    after = {r.canonical_name: r for r in got["entities"].collect()}
    assert set(after) == {"Globex Robotics", "Jane Doe"}
    assert after["Globex Robotics"].entity_id == "g" and after["Globex Robotics"].entity_type == "organization" and after["Globex Robotics"].confidence == 0.8
    assert [(r.from_id, r.to_id, r.edge_type) for r in got["edges"].collect()] == [(after["Jane Doe"].entity_id, "g", "ceo_of")]
    states = {r.candidate_id: (r.status, r.entity_id) for r in got["candidates"].collect()}
    assert states == {"1": ("resolved", after["Jane Doe"].entity_id), "2": ("auto_merged", "g"), "3": ("needs_llm", None)}
    n = got["counts"].first()
    assert (n.entities, n.ungrounded, n.relations, n.relations_rejected) == (2, 1, 1, 1)


def test_context_counts(spark):
    """A name that needs review alone merges where its item names what the candidate is linked with."""
    e = entities(spark, [("g", "unknown", "Globex Robotics", 0.5), ("p", "unknown", "Peter Gibbons", 0.5)])
    edges = spark.createDataFrame([("g", "p")], "from_id string, to_id string")
    m = spark.createDataFrame([("1", "i", "Peter Gibbons", None, NOW, 0, 0.9), ("2", "i", "Globex", None, NOW, 30, 0.9), ("3", "j", "Globex", None, NOW, 0, 0.9)], "mention_id string, item_id string, mention_text string, mention_type string, observed_at timestamp, start int, score double")
    alone = {r.candidate_id: (r.match_score, r.status) for r in resolve.resolve(m, e, F.lit(NOW))["candidates"].collect()}
    told = {r.candidate_id: (r.match_score, r.status) for r in resolve.resolve(m, e, F.lit(NOW), edges=edges)["candidates"].collect()}
    assert told == alone | {"2": (5.5, "auto_merged")} and alone["2"] == (3.8, "pending_review")
