"""Facts with a time: edges gather observations, exclusive ones replace each other, and any past state can be read."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import vocab


def accumulate(observations: DataFrame) -> DataFrame:
    """One edge for each (from_id, to_id, edge_type): weight counts observations, sources are a set, valid_at is the earliest.

    observations: from_id, to_id, edge_type, item_id, observed_at, seq (arrival). mentioned_with has no direction; loops go.
    """
    sym = F.col("edge_type") == "mentioned_with"
    rows = observations.where("from_id <> to_id").withColumns({"from_id": F.when(sym, F.least("from_id", "to_id")).otherwise(F.col("from_id")), "to_id": F.when(sym, F.greatest("from_id", "to_id")).otherwise(F.col("to_id"))})
    return rows.groupBy("from_id", "to_id", "edge_type").agg(F.count("*").cast("double").alias("weight"), F.sort_array(F.collect_set("item_id")).alias("source_item_ids"), F.min("observed_at").alias("valid_at"), F.max("observed_at").alias("last_seen"), F.min("seq").alias("seq"))


def adjacent_pairs(rows: DataFrame) -> DataFrame:
    """(item_id, a, b): neighbours among an item's distinct entity ids in order, not all pairs."""
    after = F.lead("entity_id").over(Window.partitionBy("item_id").orderBy("entity_id"))
    return rows.select("item_id", "entity_id").distinct().select("item_id", F.col("entity_id").alias("a"), after.alias("b")).where("b IS NOT NULL")


def supersede(edges: DataFrame, side: str = "from_id", order: list[str] | None = None) -> DataFrame:
    """Adds invalid_at and superseded_by to edges (edge_id, valid_at, seq) of relations that are exclusive on one side.

    In order of arrival, an edge that is not older than all before it for its (edge_type, side) ends the one then valid; one that
    comes late starts out ended, by the earliest newer one. As windows: an edge takes part in the line of succession if no earlier
    arrival is newer; such an edge is ended by the next in line, any other by the holder at its arrival.
    """
    by = Window.partitionBy("edge_type", side).orderBy(*(order or ["seq", "edge_id"]))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    df = edges.withColumn("_max", F.max("valid_at").over(before))
    df = df.withColumn("_line", F.col("_max").isNull() | (F.col("valid_at") >= F.col("_max")))
    df = df.withColumn("_holder", F.last(F.when(F.col("_line"), F.struct("valid_at", "edge_id")), ignorenulls=True).over(before))
    after = by.rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("_next", F.first(F.when(F.col("_line"), F.struct("valid_at", "edge_id")), ignorenulls=True).over(after))
    ends = F.when(F.col("_line"), F.col("_next")).otherwise(F.col("_holder"))
    return df.withColumns({"invalid_at": ends["valid_at"], "superseded_by": ends["edge_id"]}).drop("_max", "_line", "_holder", "_next")


def fold_exclusive(observations: DataFrame) -> DataFrame:
    """The exact outcome of linking observations one by one in order of seq, for relations of any exclusivity.

    observations: from_id, to_id, edge_type, item_id, observed_at, seq. Edges of relations exclusive on both sides depend on each
    other through both ends, so a relation's connected part is folded as one group: hence the key `part` (edge_type by default).
    """
    rows = observations if "part" in observations.columns else observations.withColumn("part", F.col("edge_type"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict[tuple, dict] = {}
        for r in pdf.sort_values(["seq", "item_id"]).itertuples():
            if r.from_id == r.to_id:
                continue
            key = (r.edge_type, *sorted((r.from_id, r.to_id))) if r.edge_type == "mentioned_with" else (r.edge_type, r.from_id, r.to_id)
            known = edges.get(key)
            if known:
                known["weight"] += 1
                known["source_item_ids"] = sorted({*known["source_item_ids"], r.item_id})
                known["valid_at"] = min(known["valid_at"], r.observed_at)
                continue
            new = {"edge_id": "|".join(key), "edge_type": r.edge_type, "from_id": r.from_id, "to_id": r.to_id, "weight": 1.0, "source_item_ids": [r.item_id], "valid_at": r.observed_at, "invalid_at": None, "superseded_by": None}
            newer = []
            for side, exclusive in zip(("from_id", "to_id"), vocab.EXCLUSIVE.get(r.edge_type, (False, False)), strict=True):
                if not exclusive:
                    continue
                for e in edges.values():
                    if e["edge_type"] == r.edge_type and e[side] == new[side] and e["invalid_at"] is None:
                        if e["valid_at"] <= r.observed_at:
                            e["invalid_at"], e["superseded_by"] = r.observed_at, new["edge_id"]
                        else:
                            newer.append((e["valid_at"], e["edge_id"]))
            if newer:
                new["invalid_at"], new["superseded_by"] = min(newer)
            edges[key] = new
        return pd.DataFrame(list(edges.values()), columns=["edge_id", "edge_type", "from_id", "to_id", "weight", "source_item_ids", "valid_at", "invalid_at", "superseded_by"])

    schema = "edge_id string, edge_type string, from_id string, to_id string, weight double, source_item_ids array<string>, valid_at timestamp, invalid_at timestamp, superseded_by string"
    return rows.groupBy("part").applyInPandas(fold, schema)


def as_of(edges: DataFrame, t: Column) -> DataFrame:
    """Edges that held at a time."""
    return edges.where((F.col("valid_at").isNull() | (F.col("valid_at") <= t)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t)))


def valid_now(edges: DataFrame) -> DataFrame:
    return edges.where("invalid_at IS NULL")
