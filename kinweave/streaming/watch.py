"""The standing watch: micro-batches of landed items go through ingestion and resolution into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from kinweave.operators import resolve, state
from kinweave.operators.store import Store

RAW = "source_type string, source_ref string, title string, text string, license_class string, published_at timestamp"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of raw items from JSON files in a folder."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 100).json(path)


def merged_edges(known: DataFrame | None, new: DataFrame, now) -> DataFrame:
    """Edges after those that a batch observed: weights add up, sources join, times widen; an edge that had ended stays so."""
    new = new.select(F.concat_ws("|", "edge_type", "from_id", "to_id").alias("edge_id"), "from_id", "to_id", "edge_type", "weight", "source_item_ids", now.alias("first_seen"), F.col("valid_at").cast("timestamp").alias("valid_at"), F.col("last_seen").cast("timestamp").alias("last_seen"), "seq", F.lit(None).cast("timestamp").alias("invalid_at"))
    if known is None:
        return new
    sources = F.sort_array(F.array_distinct(F.flatten(F.collect_list("source_item_ids"))))
    return known.unionByName(new).groupBy("edge_id", "from_id", "to_id", "edge_type").agg(F.sum("weight").alias("weight"), sources.alias("source_item_ids"), F.min("first_seen").alias("first_seen"), F.min("valid_at").alias("valid_at"), F.max("last_seen").alias("last_seen"), F.min("seq").alias("seq"), F.max("invalid_at").alias("invalid_at"))


def cycle(store: Store, batch: DataFrame, batch_id: int, now) -> None:
    """One micro-batch: new items by content hash against the whole store, then mentions, entities, edges and states.

    Everything is derived from the version before, all tables are written as the batch's version, and one commit makes them seen
    together. A batch that broke off before its commit starts over from the same version; one that was committed does nothing.
    """
    version = batch_id + 1
    if (store.committed() or 0) >= version:
        return
    items, entities, candidates, apart, edges = (store.read(t, version - 1) for t in ("items", "entities", "candidates", "decorrelations", "edges"))
    new = state.ingest(batch, items, now)
    empty = state.create_entities(batch.sparkSession.createDataFrame([], "entity_id string, canonical_name string, entity_type string, confidence double"), now)
    known = empty if entities is None else entities
    got = resolve.resolve(resolve.extract(new.withColumn("observed_at", F.coalesce("published_at", "ingested_at"))), known, now, candidates, apart, edges=edges)
    states = got["items"].select("item_id", F.col("status").alias("_status"))
    new = new.join(states, "item_id", "left").withColumn("status", F.coalesce("_status", F.lit("resolved"))).drop("_status")
    touched = state.touch(known, got["candidates"].where("status = 'auto_merged'"), now)
    store.write("entities", state.expire(touched.unionByName(state.create_entities(got["entities"], now)), now), version)
    store.write("candidates", got["candidates"] if candidates is None else candidates.unionByName(got["candidates"]), version)
    store.write("edges", merged_edges(edges, got["edges"], now), version)
    store.write("items", new if items is None else items.unionByName(new), version)
    store.commit(version)


def watch(spark: SparkSession, path: str, root: str, now=None, interval: str | None = None) -> StreamingQuery:
    """Starts the watch over a landing folder: what is there (interval None), or again and again."""
    store = Store(spark, root)
    rows = landed(spark, path).writeStream.option("checkpointLocation", f"{root}/_stream").foreachBatch(lambda df, i: cycle(store, df, i, now if now is not None else F.current_timestamp()))
    return rows.trigger(processingTime=interval).start() if interval else rows.trigger(availableNow=True).start()
