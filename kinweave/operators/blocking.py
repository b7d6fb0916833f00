"""Blocking: names meet only where they share a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.operators.kept import keep as _keep


def keys(name: Column, phonetics: bool = True) -> Column:
    """Distinct (key_type, key) of a name: the whole name, each content word of three bytes or more, and such words' codes."""
    norm = T.normalize(name)
    words = F.filter(T.content_tokens(norm), lambda t: F.octet_length(t) >= 3)
    made = [F.array(F.struct(F.lit("norm").alias("key_type"), norm.alias("key"))), F.transform(words, lambda t: F.struct(F.lit("token").alias("key_type"), t.alias("key")))]
    if phonetics:
        made.append(F.transform(F.filter(S.phonetic_codes(words), lambda p: p != ""), lambda p: F.struct(F.lit("phon").alias("key_type"), p.alias("key"))))
    return F.when(norm == "", F.array().cast("array<struct<key_type:string,key:string>>")).otherwise(F.array_distinct(F.concat(*made)))


def index(names: DataFrame, id_column: str = "entity_id", phonetics: bool = True) -> DataFrame:
    """(entity_id, key_type, key) of rows (entity_id, name), without repeats."""
    return names.select(id_column, F.explode(keys(F.col("name"), phonetics)).alias("k")).select(id_column, "k.key_type", "k.key").distinct()


def candidates(mention_keys: DataFrame, entity_keys: DataFrame, most: int = 50, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(mention_id, entity_id, hits): for each mention the `most` entities that share most keys; ties to the smaller id.

    Only keys of at most `most` entities are joined entity by entity. What a mention shares of the others (hot keys) is found once for
    each set of hot keys, and of the entities with the same hot keys only the `most` smallest ids take part: an entity that shares
    nothing but hot keys and comes after `most` others there comes after them for the mention too, whatever else those share.
    Rows grow with the names, not with the square of a key's names. keep: a condition on (mention_id, entity_id) of rows to return,
    asked after the limit, before rows are made; ids can be structs whose first field tells them apart.
    """
    key = F.concat_ws("|", "key_type", "key").alias("key")
    own = _keep(entity_keys.select("entity_id", key))
    counts = _keep(own.groupBy("key").agg((F.count("*") > most).alias("hot")))
    parted = [F.array_sort(F.collect_list(F.when(F.col("hot"), F.col("key")))).alias("hot_keys"), F.collect_list(F.when(~F.col("hot"), F.col("key"))).alias("keys")]
    entities = _keep(own.join(counts, "key").groupBy("entity_id").agg(*parted))
    mentions = _keep(mention_keys.select("mention_id", key).join(counts, "key").groupBy("mention_id").agg(*parted))
    ranked = F.struct((-F.col("hits")).alias("rank"), "entity_id")
    # Entities that share a key which is not hot, with all they share.
    left = mentions.select("mention_id", F.col("hot_keys").alias("ours"), F.explode("keys").alias("key"))
    right = entities.select("entity_id", F.col("hot_keys").alias("theirs"), F.explode("keys").alias("key"))
    near = left.join(right, "key").groupBy("mention_id", "entity_id").agg(F.count("*").alias("n"), F.first("ours").alias("ours"), F.first("theirs").alias("theirs"))
    near = near.withColumn("hits", F.col("n") + F.size(F.array_intersect("ours", "theirs"))).groupBy("mention_id").agg(F.collect_list(ranked).alias("near"))
    # For each set of hot keys the first entities by what they share of it.
    alike = entities.where(F.size("hot_keys") > 0).withColumn("_r", F.row_number().over(Window.partitionBy("hot_keys").orderBy("entity_id"))).where(F.col("_r") <= most)
    alike = _keep(alike.groupBy(F.col("hot_keys").alias("theirs")).agg(F.collect_list("entity_id").alias("ids")))
    sets = mentions.where(F.size("hot_keys") > 0).select(F.col("hot_keys").alias("ours")).distinct().withColumn("key", F.explode("ours"))
    met = sets.join(alike.select("theirs", F.explode("theirs").alias("key")), "key").groupBy("ours", "theirs").agg(F.count("*").alias("hits"))
    first = met.join(alike, "theirs").select("ours", "hits", F.explode("ids").alias("entity_id"))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("ours").orderBy(F.col("hits").desc(), "entity_id"))).where(F.col("_r") <= most)
    far = first.groupBy("ours").agg(F.collect_list(ranked).alias("far"))
    rows = mentions.select("mention_id", F.col("hot_keys").alias("ours")).join(near, "mention_id", "left").join(far, "ours", "left")
    none = F.array().cast(far.schema["far"].dataType)
    rows = rows.select("mention_id", F.coalesce("near", none).alias("near"), F.coalesce("far", none).alias("far")).withColumn("_ids", F.transform("near", lambda x: x["entity_id"]))
    rows = rows.withColumn("_all", F.slice(F.array_sort(F.concat("near", F.filter("far", lambda x: ~F.array_contains("_ids", x["entity_id"])))), 1, most))
    if keep is not None:
        rows = rows.withColumn("_all", F.filter("_all", lambda x: keep(F.col("mention_id"), x["entity_id"])))
    return rows.select("mention_id", F.explode("_all").alias("_x")).select("mention_id", F.col("_x.entity_id").alias("entity_id"), (-F.col("_x.rank")).alias("hits"))


def cooc_fraction(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, cooc): edges of any kind and validity between entity_id and other_ids, over how many others there are, at most 1.

    pairs: pair_id, entity_id, other_ids (array). Edges are turned both ways, so that the join is on equal keys.
    """
    both = edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    sizes = pairs.select("pair_id", F.size("other_ids").alias("n"))
    each = pairs.select("pair_id", F.col("entity_id").alias("from_id"), F.explode(F.array_distinct("other_ids")).alias("to_id"))
    found = each.join(both, ["from_id", "to_id"]).groupBy("pair_id").agg(F.count("*").alias("found"))
    return sizes.join(found, "pair_id", "left").select("pair_id", F.when(F.col("n") > 0, F.least(F.coalesce("found", F.lit(0)) / F.col("n"), F.lit(1.0))).otherwise(0.0).alias("cooc"))


def corroboration(candidates_: DataFrame) -> DataFrame:
    """(entity_id, n): distinct items that support each entity."""
    from kinweave import vocab

    return candidates_.where(F.col("status").isin(*vocab.SUPPORTED_STATUS) & F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.countDistinct("item_id").alias("n"))
