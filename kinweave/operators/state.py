"""Changes of state as snapshot transforms: each takes tables and returns the tables after the change."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import text as T


def content_hash(ref: Column, text: Column) -> Column:
    """What makes an item the same item: SHA-256 of its reference and its text."""
    return F.sha2(F.concat_ws("|", ref, text), 256)


def ingest(raw: DataFrame, store: DataFrame | None, now: Column) -> DataFrame:
    """New pending items of raw rows (source_type, source_ref, title, text, license_class, published_at): each hash once, none of
    those in store. Of equal rows the one with the least published_at and title stays."""
    rows = raw.withColumn("content_hash", content_hash(F.col("source_ref"), F.col("text")))
    fields = ["published_at", "title", "source_type", "source_ref", "text", "license_class"]
    one = rows.groupBy("content_hash").agg(F.min(F.struct(*fields)).alias("r")).select("content_hash", "r.*")
    if store is not None:
        one = one.join(store.select("content_hash"), "content_hash", "left_anti")
    return one.select(F.col("content_hash").alias("item_id"), "source_type", "source_ref", "content_hash", "title", F.col("text").alias("raw_text"), now.alias("ingested_at"), "published_at", F.lit("pending").alias("status"), F.coalesce("license_class", F.lit("unknown")).alias("license_class"))


def pending(items: DataFrame, most: int) -> DataFrame:
    """The first pending items, oldest first, with the time their facts count from."""
    return items.where("status = 'pending'").withColumn("observed_at", F.coalesce("published_at", "ingested_at")).orderBy("ingested_at", "item_id").limit(most)


def create_entities(new: DataFrame, now: Column) -> DataFrame:
    """Live entities from rows (entity_id, canonical_name, entity_type, confidence)."""
    return new.select("entity_id", "entity_type", "canonical_name", F.array().cast("array<string>").alias("aliases"), "confidence", now.alias("first_seen"), now.alias("last_seen"), F.lit(True).alias("is_live"), (now + F.expr(f"INTERVAL {vocab.LIVE_DAYS} DAYS")).alias("expiry_time"), now.alias("last_source_update"))


def touch(entities: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Entities seen again live on for another term, also those that had expired."""
    hit = ids.select("entity_id").distinct().withColumn("_hit", F.lit(True))
    df = entities.join(hit, "entity_id", "left")
    new = {"last_seen": now, "expiry_time": now + F.expr(f"INTERVAL {vocab.LIVE_DAYS} DAYS"), "last_source_update": now, "is_live": F.lit(True)}
    return df.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items() if c in entities.columns}).drop("_hit").select(entities.columns)


def add_aliases(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Adds names (entity_id, name) that are neither the canonical name nor known."""
    new = names.groupBy("entity_id").agg(F.sort_array(F.collect_set("name")).alias("_new"))
    df = entities.join(new, "entity_id", "left")
    fresh = F.filter(F.coalesce("_new", F.array().cast("array<string>")), lambda n: n != F.col("canonical_name"))
    return df.withColumn("aliases", F.array_union("aliases", fresh)).drop("_new").select(entities.columns)


def expire(entities: DataFrame, now: Column) -> DataFrame:
    """Entities past their term are no longer live."""
    return entities.withColumn("is_live", F.col("is_live") & ~F.coalesce(F.col("expiry_time") < now, F.lit(False)))


def decorrelate(known: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """Pairs that are not the same, in order, with the latest reason. pairs: a_id, b_id, reason, decided_at; an entity is never paired with itself."""
    rows = pairs.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "reason", "decided_at")
    rows = rows if known is None else rows.unionByName(known)
    last = rows.groupBy("a_id", "b_id").agg(F.max(F.struct("decided_at", "reason")).alias("r"))
    return last.select("a_id", "b_id", "r.reason", "r.decided_at")


def merge_entities(entities: DataFrame, edges: DataFrame, candidates: DataFrame, decorrelations: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Takes absorb_id into keep_id for each row of merges; refused for the same, unknown or decorrelated entities.

    The survivor gets the other's names and the higher confidence; edges and candidates move to it, and so do decorrelations, so that
    a human decision outlives the merge. Loops and double edges that arise stay (compact_edges() joins them).
    """
    pairs = merges.where("keep_id <> absorb_id").select("keep_id", "absorb_id", F.least("keep_id", "absorb_id").alias("a_id"), F.greatest("keep_id", "absorb_id").alias("b_id"))
    pairs = pairs.join(decorrelations.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti")
    ids = entities.select("entity_id")
    ok = pairs.join(ids, F.col("keep_id") == F.col("entity_id"), "left_semi").join(ids, F.col("absorb_id") == F.col("entity_id"), "left_semi").select("keep_id", "absorb_id")
    gone = entities.join(ok, F.col("entity_id") == F.col("absorb_id")).groupBy(F.col("keep_id").alias("entity_id")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("canonical_name")))))).alias("_names"), F.max("confidence").alias("_conf"))
    kept = entities.join(ok, F.col("entity_id") == F.col("absorb_id"), "left_anti").join(gone, "entity_id", "left")
    kept = kept.withColumn("aliases", F.array_union("aliases", F.filter(F.coalesce("_names", F.array().cast("array<string>")), lambda n: n != F.col("canonical_name")))).withColumn("confidence", F.greatest("confidence", "_conf"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        to = ok.select(F.col("absorb_id").alias(column), F.col("keep_id").alias("_to"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to").select(df.columns)

    apart = moved(moved(decorrelations, "a_id"), "b_id")
    return kept.select(entities.columns), moved(moved(edges, "from_id"), "to_id"), moved(candidates, "entity_id"), decorrelate(None, apart)


def compact_edges(edges: DataFrame) -> DataFrame:
    """Edges without loops, equal ones joined: weights add up, sources unite, the earliest valid_at stays."""
    return edges.where("from_id <> to_id").groupBy("from_id", "to_id", "edge_type").agg(F.sum("weight").alias("weight"), F.array_distinct(F.flatten(F.collect_list("source_item_ids"))).alias("source_item_ids"), F.min("valid_at").alias("valid_at"))


def apply_decisions(candidates: DataFrame, decisions: DataFrame, now: Column) -> dict[str, DataFrame]:
    """What human decisions (candidate_id, decision, actor, reason) change: candidates, new entities, decorrelations, touched entities, the log.

    confirm keeps the proposed entity; reject makes a new one (confidence 0.7) and holds the two apart; new makes a new one. Any
    status may be decided on; an unknown decision is an error.
    """
    bad = F.when(~F.col("decision").isin("confirm", "reject", "new"), F.raise_error(F.concat(F.lit("unknown decision: "), F.col("decision"))))
    rows = candidates.join(decisions.withColumn("_check", bad).where("_check IS NULL").drop("_check"), "candidate_id")
    made = F.sha2(F.concat_ws("|", F.lit("decision"), "candidate_id"), 256)
    rows = rows.withColumn("_new", F.when(F.col("decision") != "confirm", made))
    after = candidates.join(rows.select("candidate_id", "_new", "decision"), "candidate_id", "left")
    status = F.when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "reject", "rejected").when(F.col("decision") == "new", "new").otherwise(F.col("status"))
    after = after.withColumn("status", status).withColumn("entity_id", F.coalesce("_new", "entity_id")).select(candidates.columns)
    fresh = rows.where("_new IS NOT NULL")
    return {
        "candidates": after,
        "entities": create_entities(fresh.select(F.col("_new").alias("entity_id"), F.col("mention_text").alias("canonical_name"), F.coalesce("mention_type", F.lit("unknown")).alias("entity_type"), F.lit(0.7).alias("confidence")), now),
        "decorrelations": decorrelate(None, rows.where("decision = 'reject' AND entity_id IS NOT NULL").select(F.col("entity_id").alias("a_id"), F.col("_new").alias("b_id"), "reason", now.alias("decided_at"))),
        "touched": rows.where("decision = 'confirm'").select("entity_id", F.col("mention_text").alias("name")),
        "decisions": rows.select(F.sha2(F.concat_ws("|", "candidate_id", "decision", "actor"), 256).alias("decision_id"), "candidate_id", "decision", "actor", "reason", now.alias("decided_at")),
    }


def prune(entities: DataFrame) -> DataFrame:
    """Entities whose names are no names."""
    return entities.where(~T.plausible_name(F.col("canonical_name"), F.col("entity_type")))


def without_entities(gone: DataFrame, entities: DataFrame, edges: DataFrame, candidates: DataFrame, decorrelations: DataFrame, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables without given entities; their candidates are detached."""
    ids = gone.select(F.col("entity_id").alias("_gone"))
    anti = lambda df, c: df.join(ids, F.col(c) == F.col("_gone"), "left_anti")
    loose = candidates.join(ids, F.col("entity_id") == F.col("_gone"), "left")
    loose = loose.withColumn("status", F.when(F.col("_gone").isNotNull(), "rejected_name").otherwise(F.col("status"))).withColumn("entity_id", F.when(F.col("_gone").isNull(), F.col("entity_id"))).select(candidates.columns)
    return {"entities": anti(entities, "entity_id"), "edges": anti(anti(edges, "from_id"), "to_id"), "candidates": loose, "decorrelations": anti(anti(decorrelations, "a_id"), "b_id"), "keys": anti(keys, "entity_id")}


def quota(asks: DataFrame, limits: DataFrame) -> DataFrame:
    """(token_id, day, asks, remaining, allowed) from asks (token_id, at) and limits (token_id, ask_daily_limit; null: none)."""
    used = asks.groupBy("token_id", F.to_date("at").alias("day")).agg(F.count("*").alias("asks"))
    left = F.when(F.col("ask_daily_limit").isNotNull(), F.greatest(F.col("ask_daily_limit") - F.col("asks"), F.lit(0)))
    return used.join(limits, "token_id", "left").select("token_id", "day", "asks", left.alias("remaining"), F.coalesce(F.col("asks") < F.col("ask_daily_limit"), F.lit(True)).alias("allowed"))


#: What a token begins with, so that a leaked one is easily found.
TOKEN_PREFIX = "enk_"


def generate_token() -> str:
    """A new token in plain text: 128 random bits."""
    return TOKEN_PREFIX + secrets.token_hex(16)


def create_token(tokens: DataFrame, plain: str, name: str, role: str, now: Column, ask_daily_limit: int | None = None, license_filter: str | None = None) -> DataFrame:
    """tokens with one more, of which only the hash is kept."""
    row = tokens.sparkSession.range(1).select(
        F.sha2(F.lit("id|" + plain), 256).alias("token_id"), F.sha2(F.lit(plain), 256).alias("token_hash"), F.lit(name).alias("name"), F.lit(role).alias("role"),
        F.lit(ask_daily_limit).cast("long").alias("ask_daily_limit"), F.lit(license_filter).cast("string").alias("license_filter"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"),
    )
    return tokens.unionByName(row, allowMissingColumns=True)


def revoke_token(tokens: DataFrame, token_id: str, now: Column) -> DataFrame:
    """tokens with that one revoked; the time of an earlier revocation stays."""
    return tokens.withColumn("revoked_at", F.when(F.col("token_id") == token_id, F.coalesce("revoked_at", now)).otherwise(F.col("revoked_at")))


def authenticate(bearers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of bearers (bearer) with the token they are for (token_hash), revoked ones left out."""
    return bearers.withColumn("token_hash", F.sha2("bearer", 256)).join(tokens.where("revoked_at IS NULL"), "token_hash", "left")


def can_decide(role: Column) -> Column:
    return role.isin("operator", "analyst")


def can_decorrelate(role: Column) -> Column:
    return role == "operator"
