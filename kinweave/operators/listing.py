"""Listings, look-ups and exports over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators import blocking, temporal


def search_entities(entities: DataFrame, text: str, most: int = 50, phonetics: bool = True) -> DataFrame:
    """(entity_id, hits) of the entities whose names share blocking keys with a text, most keys first, at most 500 of them."""
    names = entities.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    asked = entities.sparkSession.range(1).select(F.lit("q").alias("mention_id"), F.lit(text).alias("name"))
    found = blocking.candidates(blocking.index(asked, "mention_id", phonetics), blocking.index(names, phonetics=phonetics), max(1, min(most, 500)))
    return found.select("entity_id", "hits")


def typed_edges(edges: DataFrame, most: int = 200, as_of=None) -> DataFrame:
    """The heaviest typed relations that are valid now or were at a time."""
    valid = temporal.valid_now(edges) if as_of is None else temporal.as_of(edges, as_of)
    return valid.where("edge_type <> 'mentioned_with'").orderBy(F.col("weight").desc(), "edge_id").limit(max(1, min(most, 2000)))


def top_corroborated(entities: DataFrame, candidates: DataFrame, most: int = 25) -> DataFrame:
    """(entity_id, canonical_name, entity_type, n): the entities that most items support."""
    support = blocking.corroboration(candidates)
    return support.join(entities.select("entity_id", "canonical_name", "entity_type"), "entity_id").orderBy(F.col("n").desc(), "entity_id").limit(most)


def ungeocoded(entities: DataFrame, geo: DataFrame | None) -> DataFrame:
    """Live locations without a place yet."""
    rows = entities.where("entity_type = 'location' AND is_live")
    return rows if geo is None else rows.join(geo.select("entity_id"), "entity_id", "left_anti")


def upsert_geo(geo: DataFrame | None, hits: DataFrame) -> DataFrame:
    """geo with the hits in place of what it had for their entities."""
    return hits if geo is None else geo.join(hits.select("entity_id"), "entity_id", "left_anti").unionByName(hits)


def latest_states(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """(source_ref, mention_text, status, entity_id, match_score) of the last candidate of each source and mention (observed_at, candidate_id)."""
    rows = candidates.join(items.select("item_id", "source_ref"), "item_id")
    last = F.max_by(F.struct("status", "entity_id", "match_score"), F.struct("observed_at", "candidate_id"))
    return rows.groupBy("source_ref", "mention_text").agg(last.alias("c")).select("source_ref", "mention_text", "c.*")


def strongest_mentions(mentions: DataFrame) -> DataFrame:
    """Of an item's mentions with one surface form, whatever the case, the one with the best score; the first of equals."""
    order = Window.partitionBy("item_id", F.lower("mention_text")).orderBy(F.col("score").desc(), "start")
    return mentions.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def breakdown(contributions: Column) -> Column:
    """Contributions as `name +x.x, name -x.x`."""
    return F.array_join(F.transform(contributions, lambda c: F.format_string("%s %+.1f", c["name"], c["weight"])), ", ")


def graph_rows(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json) of live entities and edges valid now, one JSON object a row, to be written as text from where they lie."""
    e = entities.where("is_live").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.to_json(F.struct(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), "entity_type", "aliases", "confidence", "is_live")).alias("json"))
    v = temporal.valid_now(edges).select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), F.to_json(F.struct(F.col("from_id").alias("from"), F.col("to_id").alias("to"), "edge_type", "weight", "valid_at", "invalid_at", F.col("source_item_ids").alias("sources"))).alias("json"))
    return e.unionByName(v)


def brief(mission: str, answers: list[tuple[str, str]], entities: DataFrame, edges: DataFrame, candidates: DataFrame, items: DataFrame) -> str:
    """A mission's results as Markdown: counts, questions with their answers, entities by type, the most corroborated ones, and the
    heaviest typed relations. Every part that reaches the driver is a count, a group by type, or a list of bounded length."""
    names = entities.select("entity_id", "canonical_name")
    valid = temporal.valid_now(edges)
    typed = typed_edges(edges, 40).join(names.toDF("from_id", "a"), "from_id").join(names.toDF("to_id", "b"), "to_id").orderBy(F.col("weight").desc(), "edge_id")
    n = valid.agg(F.count("*").alias("all"), F.count_if(F.col("edge_type") != "mentioned_with").alias("typed")).first()
    out = [f"# {mission}", "", f"{items.count()} items; {entities.where('is_live').count()} live entities; {n['all']} valid relations ({n['typed']} typed)"]
    for question, answer in answers:
        out += ["", f"## {question}", "", answer]
    out += ["", "## Entities by type", "", *[f"- {r.entity_type}: {r['n']}" for r in entities.where("is_live").groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity_type").collect()]]
    out += ["", "## Most corroborated entities", "", *[f"- {r.canonical_name} ({r.entity_type}): {r['n']}" for r in top_corroborated(entities, candidates).collect()]]
    out += ["", "## Typed relations", "", *[f"- {r.a} {r.edge_type} {r.b} ({r.weight:g})" for r in typed.collect()]]
    return "\n".join(out) + "\n"


def open_principal() -> dict:
    """Who asks where no token is configured: anyone, with all rights."""
    return {"token_id": None, "name": "anonymous (no token configured)", "role": "operator", "ask_daily_limit": None, "license_filter": None}


def whoami(principal: dict) -> dict:
    """A principal's own view: never the token or its hash."""
    return {k: principal.get(k) for k in ("token_id", "name", "role", "ask_daily_limit", "license_filter")}

