"""Reading the graph: hubs, neighbourhoods, slices, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hubs(edges: DataFrame, n: int, types: list[str] | None = None) -> DataFrame:
    """(entity_id, degree) of the n nodes with most valid edges (of given types); ties to the smaller id."""
    rows = edges.where("invalid_at IS NULL")
    if types is not None:
        rows = rows.where(F.col("edge_type").isin(*types))
    ends = rows.select(F.explode(F.array("from_id", "to_id")).alias("entity_id"))
    return ends.groupBy("entity_id").agg(F.count("*").alias("degree")).orderBy(F.col("degree").desc(), "entity_id").limit(n)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(edge_id, depth) of edges that a breadth-first walk from seeds (entity_id) expands, each at the depth of the end reached first.

    Edges are turned both ways once; a hop is an equi-join with the frontier and an anti-join with what was reached. Each frontier
    is cut off with a reliable checkpoint where the session has a checkpoint folder.
    """
    spark = edges.sparkSession
    keep = (lambda df: df.checkpoint()) if spark.sparkContext.getCheckpointDir() else (lambda df: df)
    both = edges.select("edge_id", F.col("from_id").alias("at"), F.col("to_id").alias("to")).unionByName(edges.select("edge_id", F.col("to_id").alias("at"), F.col("from_id").alias("to")))
    frontier = keep(seeds.select(F.col("entity_id").alias("at")).distinct())
    reached, found = frontier, None
    for d in range(depth):
        hop = both.join(frontier, "at")
        seen = hop.select("edge_id", F.lit(d).alias("depth"))
        found = seen if found is None else found.unionByName(seen)
        if d + 1 < depth:
            frontier = keep(hop.select(F.col("to").alias("at")).distinct().join(reached, "at", "left_anti"))
            reached = reached.unionByName(frontier)
    return found.groupBy("edge_id").agg(F.min("depth").alias("depth"))


def ranked_slice(edges: DataFrame, preferred: list[str], most: int = 60) -> DataFrame:
    """The first edges of a slice (with depth): preferred types, then typed before mentioned_with, then near, heavy, and by id; adds rank."""
    order = [F.when(F.col("edge_type").isin(*preferred), 0).otherwise(1) if preferred else F.lit(1), F.when(F.col("edge_type") == "mentioned_with", 1).otherwise(0), F.col("depth"), F.col("weight").desc(), F.col("edge_id")]
    top = edges.orderBy(*order).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def license_filter(edges: DataFrame, items: DataFrame, license_class: str) -> DataFrame:
    """Edges with a source of the class; their other sources are taken off."""
    clean = items.where(F.col("license_class") == license_class).select(F.col("item_id").alias("_item"))
    each = edges.select("edge_id", F.explode("source_item_ids").alias("_item")).join(clean, "_item", "left_semi")
    kept = each.groupBy("edge_id").agg(F.sort_array(F.collect_set("_item")).alias("source_item_ids"))
    return edges.drop("source_item_ids").join(kept, "edge_id")


def source_numbers(ranked: DataFrame, items: DataFrame, most: int = 30) -> DataFrame:
    """(number, item_id, ...): sources numbered as they first appear in ranked edges; those not in store leave their numbers out."""
    first = ranked.select("rank", F.posexplode("source_item_ids").alias("pos", "item_id")).groupBy("item_id").agg(F.min(F.struct("rank", "pos")).alias("at"))
    numbered = first.orderBy("at").limit(most).withColumn("number", F.row_number().over(Window.orderBy("at"))).select("number", "item_id")
    return numbered.join(items, "item_id")


def timeline(edges: DataFrame, entity_id: Column | str) -> DataFrame:
    """Typed edges of an entity by time, undated ones first."""
    e = F.lit(entity_id) if isinstance(entity_id, str) else entity_id
    return edges.where(((F.col("from_id") == e) | (F.col("to_id") == e)) & (F.col("edge_type") != "mentioned_with")).orderBy(F.col("valid_at").asc_nulls_first(), "edge_id")
