"""The domain's tables, made from the test tables, so that every operator has whole tables to run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import text as T

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source items; the licence goes by doc_id."""
    d = table(spark, sf_dir, "documents")
    license_ = F.when(F.col("doc_id") % 3 == 0, "commercial_clean").when(F.col("doc_id") % 3 == 1, "noncommercial").otherwise("unknown")
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int))")
    return d.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("item_id"), F.col("source").alias("source_type"), F.col("source").alias("source_ref"), F.sha2(F.concat_ws("|", "source", "text"), 256).alias("content_hash"), F.lit("title").alias("title"), F.col("text").alias("raw_text"), at.alias("published_at"), license_.alias("license_class"), F.when(F.col("doc_id") % 4 == 0, "pending").otherwise("resolved").alias("status"), "doc_id")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate for each mention of each document, its entity the mention itself."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.mention_texts(F.col("text"))).alias("mention"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("auto_merged", "pending_review", "needs_llm", "resolved", "confirmed")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(F.concat_ws("|", F.concat(F.lit("doc"), F.col("doc_id")), "mention").alias("candidate_id"), F.concat(F.lit("doc"), F.col("doc_id")).alias("item_id"), F.col("mention").alias("mention_text"), F.col("mention").alias("entity_id"), (F.col("doc_id") % 8 / 1.0).alias("match_score"), status.alias("status"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, organizations, locations and persons, with the time they were last seen."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("product:"), F.col("p_name")).alias("entity_id"), F.lit("product").alias("entity_type"), F.initcap("p_name").alias("canonical_name"), F.col("k").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("organization:"), F.col("s_suppkey")).alias("entity_id"), F.lit("organization").alias("entity_type"), F.col("s_name").alias("canonical_name"), F.col("s_suppkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("location:"), F.col("n_name")).alias("entity_id"), F.lit("location").alias("entity_type"), F.initcap("n_name").alias("canonical_name"), F.col("n_nationkey").cast("long").alias("k"))
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("seen")).select(F.concat(F.lit("person:"), F.col("user_id")).alias("entity_id"), F.lit("person").alias("entity_type"), F.concat(F.lit("User "), F.col("user_id")).alias("canonical_name"), F.col("user_id").alias("k"), F.col("seen"))
    seen = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(k % 60 as int))")
    rest = p.unionByName(s).unionByName(n).withColumn("seen", seen)
    return rest.unionByName(u).select("entity_id", "entity_type", "canonical_name", F.array().cast("array<string>").alias("aliases"), (F.col("k") % 10 / 10.0).alias("confidence"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"), (F.col("k") % 7 != 0).alias("is_live"), (F.col("seen") + F.expr("interval 30 days")).alias("expiry_time"), F.col("seen").alias("last_source_update"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which supplier a part was shipped from and when: parts are owned_by suppliers, one at a time."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("part:"), F.col("l_partkey")).alias("from_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("to_id"), F.lit("owned_by").alias("edge_type"), F.concat(F.lit("order"), F.col("l_orderkey")).alias("item_id"), F.col("l_shipdate").alias("observed_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of customers, nations, regions and suppliers, with every third customer's edge ended."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("from_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("to_id"), F.lit("based_in").alias("edge_type"), (F.col("c_custkey") % 4 / 1.0).alias("weight"), F.col("c_custkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("from_id"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("to_id"), F.lit("headquartered_in").alias("edge_type"), (F.col("s_suppkey") % 4 / 1.0).alias("weight"), F.col("s_suppkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("to_id"), F.lit("mentioned_with").alias("edge_type"), F.lit(1.0).alias("weight"), F.col("n_nationkey").cast("long").alias("k"))
    day = lambda n: F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast({n} as int))")
    ids = F.array(F.concat(F.lit("doc"), F.col("k") % 100), F.concat(F.lit("doc"), (F.col("k") + 1) % 100))
    return c.unionByName(s).unionByName(n).select(F.concat_ws("|", "edge_type", "from_id", "to_id").alias("edge_id"), "from_id", "to_id", "edge_type", "weight", ids.alias("source_item_ids"), day("k % 30").alias("first_seen"), day("k % 30").alias("valid_at"), F.when(F.col("k") % 3 == 0, day("k % 30 + 20")).alias("invalid_at"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and ways to write them, against each name that shares a word: pairs for the scorer."""
    p = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("name")).distinct()
    ways = F.array(F.col("name"), F.upper("name"), F.replace("name", F.lit(" "), F.lit(".")), F.array_join(F.reverse(F.split("name", " ")), " "), F.concat("name", F.lit(" Inc")), F.expr("left(name, length(name) - 1)"), F.replace("name", F.lit(" "), F.lit("")))
    m = p.select(F.explode(F.array_distinct(ways)).alias("mention")).withColumn("w", F.explode(F.split(F.lower(F.replace("mention", F.lit("."), F.lit(" "))), " ")))
    c = p.select(F.col("name").alias("canonical")).withColumn("w", F.explode(F.split(F.lower("canonical"), " ")))
    return m.join(c, "w").select("mention", "canonical").distinct()
