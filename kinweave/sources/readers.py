"""Readers of feeds and reference data. Fetching is left to what lands files; these parse what has landed."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import recover as R
from kinweave.functions import text as T

RAW = ["source_type", "source_ref", "title", "text", "license_class", "published_at"]
LABELLED = "mention string, mention_type string, candidate string, candidate_type string, candidate_aliases array<string>, is_match boolean"


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed RSS and Atom files as raw items: what describes an entry is joined, the first date counts."""
    rss = "title string, link string, description string, pubDate string, `content:encoded` string, `dc:date` string"
    atom = "title string, link struct<_href:string,_VALUE:string>, summary string, content string, updated string, published string"
    a = spark.read.format("xml").option("rowTag", "item").schema(rss).load(path)
    b = spark.read.format("xml").option("rowTag", "entry").schema(atom).load(path)
    joined = lambda *c: T.strip_tags(F.concat_ws(" ", *c))
    items = a.select(F.col("link").alias("source_ref"), "title", joined("description", "content:encoded").alias("body"), F.coalesce("pubDate", "dc:date").alias("date"))
    entries = b.select(F.coalesce("link._href", "link._VALUE").alias("source_ref"), "title", joined("summary", "content").alias("body"), F.coalesce("published", "updated").alias("date"))
    rows = items.unionByName(entries).where("source_ref IS NOT NULL")
    return rows.select(F.lit("rss").alias("source_type"), F.trim("source_ref").alias("source_ref"), F.trim("title").alias("title"), F.concat_ws("\n\n", "title", "body").alias("text"), F.lit("unknown").alias("license_class"), R.parse_feed_date(F.col("date")).alias("published_at"))


def gdelt(spark: SparkSession, path: str) -> DataFrame:
    """Articles of landed search answers; those without an address or title are left out."""
    df = spark.read.option("multiLine", True).schema("articles array<struct<url:string,title:string,domain:string,seendate:string>>").json(path)
    a = df.select(F.explode("articles").alias("a")).select("a.*").where("coalesce(trim(url), '') <> '' AND coalesce(trim(title), '') <> ''")
    return a.select(F.lit("gdelt").alias("source_type"), F.col("url").alias("source_ref"), "title", F.concat("title", F.lit(" ("), F.coalesce("domain", F.lit("")), F.lit(")")).alias("text"), F.lit("commercial_clean").alias("license_class"), R.parse_feed_date(F.col("seendate")).alias("published_at"))


def quakes(spark: SparkSession, path: str) -> DataFrame:
    """Events of landed GeoJSON; features with fewer than two coordinates are left out, a missing depth is 0, a null magnitude stays."""
    schema = "features array<struct<id:string,properties:struct<mag:double,place:string,time:long,type:string,title:string,url:string,status:string>,geometry:struct<coordinates:array<double>>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f")).select("f.*")
    at = lambda i: F.get(F.col("geometry.coordinates"), F.lit(i))
    return f.where(F.size("geometry.coordinates") >= 2).select("id", F.col("properties.mag").alias("mag"), F.col("properties.place").alias("place"), F.timestamp_millis("properties.time").alias("at"), F.coalesce("properties.type", F.lit("earthquake")).alias("event_type"), "properties.title", "properties.url", at(0).alias("lon"), at(1).alias("lat"), F.coalesce(at(2), F.lit(0.0)).alias("depth_km"))


def quake_escalations(events: DataFrame) -> DataFrame:
    """Events that are no earthquakes, or strong ones."""
    return events.where((F.col("event_type") != "earthquake") | (F.coalesce("mag", F.lit(0.0)) >= vocab.ESCALATE_MAGNITUDE))


def gazetteer(spark: SparkSession, cities: str, countries: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """places, names and countries from tab-separated files (at least 15 and 6 fields; ids and coordinates must be numbers)."""
    f = lambda i: F.get(F.col("f"), F.lit(i))
    rows = spark.read.text(cities).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 15)
    places = rows.select(F.try_to_number(f(0), F.lit("9999999999")).cast("long").alias("geonameid"), f(1).alias("name"), f(2).alias("ascii"), f(3).alias("alternates"), f(4).try_cast("double").alias("lat"), f(5).try_cast("double").alias("lon"), f(7).alias("feature_code"), f(8).alias("country"), F.coalesce(f(14).try_cast("long"), F.lit(0)).alias("population"))
    places = places.where("geonameid IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    own = F.array(T.normalize(F.col("name")), T.normalize(F.col("ascii")))
    other = F.filter(F.transform(F.split("alternates", ","), T.normalize), lambda n: F.length(n) >= 3)
    names = places.select(F.explode(F.array_distinct(F.concat(own, other))).alias("name_norm"), "geonameid").where("name_norm <> ''")
    lands = spark.read.text(countries).where("trim(value) <> '' AND NOT value LIKE '#%'").select(F.split("value", "\t").alias("f")).where(F.size("f") >= 6)
    return places.drop("alternates"), names, lands.select(f(0).alias("iso"), T.normalize(f(4)).alias("name_norm"), f(4).alias("name"), f(5).alias("capital"))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs, one JSON object a line; a line that is none is an error."""
    df = spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path)
    return df.withColumns({"candidate_type": F.coalesce("candidate_type", F.lit("")), "candidate_aliases": F.coalesce("candidate_aliases", F.array().cast("array<string>"))})


def mission(path: str) -> dict:
    """A mission's settings; all but the name have defaults."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    if "name" not in found:
        raise ValueError(f"{path} has no name")
    return {"description": "", "target_class": None, "rss": [], "gdelt": [], "questions": [], "as_of": None} | found


def newer_than(rows: DataFrame, column: str, cursor: DataFrame, most: int, tie: str) -> DataFrame:
    """The first rows after a cursor (a table of one row, `cursor`; null: from the start), in order."""
    return rows.join(F.broadcast(cursor.select("cursor"))).where(F.col("cursor").isNull() | (F.col(column) > F.col("cursor"))).orderBy(column, tie).limit(most).drop("cursor")
