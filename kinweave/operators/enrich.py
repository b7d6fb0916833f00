"""Tier 2: what a model extracted from an item becomes resolved entities and typed relations, if the item's text bears it out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import grounding as G
from kinweave.functions import recover as R
from kinweave.functions import text as T
from kinweave.operators import blocking, scoring, state, temporal

#: Characters of an item that a model is shown.
SHOWN = 4000


def waiting(candidates: DataFrame, most: int) -> DataFrame:
    """(item_id) of items with a candidate that needs a model, in order of their ids."""
    return candidates.where("status = 'needs_llm'").select("item_id").distinct().orderBy("item_id").limit(most)


def sane_canonical(rows: DataFrame, weights: vocab.Weights | None = None, phonetics: bool = True) -> DataFrame:
    """rows (mention, canonical_name, entity_type, ...) with `canonical`: the name given, or the mention where the scorer finds the two
    to be different things."""
    pairs = rows.select("mention", "canonical_name", "entity_type").distinct().withColumn("canonical", F.col("canonical_name")).withColumn("mention_type", F.col("entity_type"))
    pairs = pairs.withColumns({"aliases": F.array().cast("array<string>"), "cooc": F.lit(0.0), "corroboration": F.lit(0).cast("long"), "recent": F.lit(False)})
    judged = scoring.score(pairs, weights, phonetics).select("mention", "canonical_name", "entity_type", "decision")
    same = F.lower(F.trim("mention")) == F.lower(F.trim("canonical_name"))
    keep = same | (F.col("decision") != "new")
    return rows.join(judged, ["mention", "canonical_name", "entity_type"]).withColumn("canonical", F.when(keep, F.col("canonical_name")).otherwise(F.col("mention"))).drop("decision")


def upsert(found: DataFrame, entities: DataFrame, now, candidates: DataFrame | None = None, decorrelations: DataFrame | None = None, weights: vocab.Weights | None = None, phonetics: bool = True) -> tuple[DataFrame, DataFrame]:
    """entities after found rows (mention, canonical, entity_type, confidence), and (canonical, entity_type, entity_id).

    A canonical name that merges with an entity adds itself and its mentions as aliases, raises the confidence, gives a type where that
    was unknown, and lets the entity live on. All others, also those that a human would have to look at, become new entities, one for
    each name and type of a batch.
    """
    w = weights or vocab.Weights()
    names = found.groupBy("canonical", "entity_type").agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("mention")).alias("mentions"))
    names = names.withColumn("mention_id", F.sha2(F.concat_ws("|", F.lit("tier2"), "canonical", "entity_type"), 256))
    known = entities.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    pairs = blocking.candidates(blocking.index(names.select("mention_id", F.col("canonical").alias("name")), "mention_id", phonetics), blocking.index(known, phonetics=phonetics))
    rows = pairs.join(names.select("mention_id", F.col("canonical").alias("mention"), F.col("entity_type").alias("mention_type")), "mention_id")
    rows = rows.join(entities.select("entity_id", F.col("canonical_name").alias("canonical"), "aliases", "entity_type", (F.col("last_seen") > now - F.expr(f"INTERVAL {vocab.LIVE_DAYS} DAYS")).alias("recent")), "entity_id")
    rows = rows.withColumn("cooc", F.lit(0.0))
    if candidates is not None:
        rows = rows.join(blocking.corroboration(candidates).withColumnRenamed("n", "corroboration"), "entity_id", "left").withColumn("corroboration", F.coalesce("corroboration", F.lit(0).cast("long")))
    else:
        rows = rows.withColumn("corroboration", F.lit(0).cast("long"))
    best = scoring.best_candidates(scoring.score(rows, w, phonetics).select("mention_id", "entity_id", "hits", "total", "contributions"), decorrelations, w)
    placed = names.join(best.where("decision = 'merge'").select("mention_id", "entity_id"), "mention_id", "left")
    made = F.sha2(F.concat_ws("|", F.lit("entity"), "mention_id"), 256)
    fresh = placed.where("entity_id IS NULL").drop("entity_id").withColumn("entity_id", made)
    merged = placed.where("entity_id IS NOT NULL")
    gains = merged.groupBy("entity_id").agg(F.max("confidence").alias("_confidence"), F.min("entity_type").alias("_type"))
    after = state.add_aliases(state.touch(entities, merged, now), merged.select("entity_id", F.explode(F.concat("mentions", F.array("canonical"))).alias("name")))
    after = after.join(gains, "entity_id", "left").withColumns({"confidence": F.greatest("confidence", F.coalesce("_confidence", "confidence")), "entity_type": F.when(F.col("entity_type") == "unknown", F.coalesce("_type", "entity_type")).otherwise(F.col("entity_type"))}).select(entities.columns)
    new = state.create_entities(fresh.select("entity_id", F.col("canonical").alias("canonical_name"), "entity_type", "confidence"), now)
    new = state.add_aliases(new, fresh.select("entity_id", F.explode("mentions").alias("name")))
    ids = placed.select("canonical", "entity_type", F.coalesce("entity_id", made).alias("entity_id"))
    return after.unionByName(new.select(entities.columns)), ids


def apply_answers(answers: DataFrame, items: DataFrame, entities: DataFrame, candidates: DataFrame, now, decorrelations: DataFrame | None = None, weights: vocab.Weights | None = None, phonetics: bool = True) -> dict[str, DataFrame]:
    """What a model's answers (item_id, answer) change: entities, candidates, relation observations, and counts.

    An entity counts if its mention occurs in the text shown and is a plausible name; a relation if both its ends do and the text
    grounds it. Candidates of an item that wait for a model and whose mention was resolved are resolved; answers without a JSON object
    leave everything as it is, so that the item is asked about again.
    """
    shown = items.select("item_id", F.substring("raw_text", 1, SHOWN).alias("text"), F.coalesce("published_at", "ingested_at").alias("observed_at"))
    got = answers.withColumn("json", R.extract_json_object(F.col("answer"))).where("json IS NOT NULL").select("item_id", R.decode_extraction(F.col("json")).alias("x")).join(shown, "item_id")
    e = got.select("item_id", "text", F.explode("x.entities").alias("e")).select("item_id", "text", "e.*")
    e = e.withColumn("ok", G.grounded(F.lower("text"), F.col("mention")) & T.plausible_name(F.col("mention"), F.col("entity_type")))
    good = sane_canonical(e.where("ok").drop("ok"), weights, phonetics)
    good = good.withColumn("canonical", F.when(T.plausible_name(F.col("canonical"), F.col("entity_type")), F.col("canonical")).otherwise(F.col("mention")))
    after, ids = upsert(good.select("mention", "canonical", "entity_type", "confidence"), entities, now, candidates, decorrelations, weights, phonetics)
    placed = good.join(ids, ["canonical", "entity_type"])
    # A relation may name an end by its mention or by its canonical name; of several the last name in order counts.
    by = placed.select("item_id", "mention", "entity_type", "entity_id", F.explode(F.array_distinct(F.array(F.lower("mention"), F.lower("canonical_name")))).alias("key"))
    by = by.groupBy("item_id", "key").agg(F.max(F.struct("mention", "entity_type", "entity_id")).alias("at"))
    end = lambda side: by.select("item_id", F.col("key").alias(f"k{side}"), F.col("at").alias(side))
    r = got.select("item_id", "text", "observed_at", F.explode("x.relations").alias("r")).select("item_id", "text", "observed_at", F.lower("r.a").alias("ka"), F.lower("r.b").alias("kb"), F.col("r.relation").alias("relation"))
    r = r.join(end("a"), ["item_id", "ka"]).join(end("b"), ["item_id", "kb"])
    r = r.withColumn("ok", F.coalesce(G.relation_grounded(F.col("text"), F.col("a.mention"), F.col("b.mention"), F.col("relation"), F.col("a.entity_type"), F.col("b.entity_type")), F.lit(False)))
    seq = F.unix_micros(F.col("observed_at").cast("timestamp"))
    observed = r.where("ok").select(F.col("a.entity_id").alias("from_id"), F.col("b.entity_id").alias("to_id"), T.normalize_relation(F.col("relation")).alias("edge_type"), "item_id", "observed_at", seq.alias("seq"))
    hit = by.select("item_id", F.col("key").alias("_key"), F.col("at.entity_id").alias("_entity"))
    done = candidates.join(hit, (candidates["item_id"] == hit["item_id"]) & (F.lower(candidates["mention_text"]) == F.col("_key")) & (candidates["status"] == "needs_llm"), "left").drop(hit["item_id"])
    done = done.withColumns({"entity_id": F.coalesce("_entity", "entity_id"), "status": F.when(F.col("_entity").isNotNull(), "resolved").otherwise(F.col("status"))}).select(candidates.columns)
    counts = e.agg(F.count_if("ok").alias("entities"), F.count_if(~F.col("ok")).alias("ungrounded")).join(r.agg(F.count_if("ok").alias("relations"), F.count_if(~F.col("ok")).alias("relations_rejected")))
    return {"entities": after, "candidates": done, "edges": temporal.accumulate(observed), "counts": counts}

