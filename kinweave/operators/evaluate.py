"""Precision and recall of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import grounding as G
from kinweave.functions import text as T
from kinweave.operators.kept import discard, keep


def confusion(predicted: Column, truth: Column) -> list[Column]:
    """The four counts, as aggregates."""
    return [F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn")]


def with_prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1; each is 0 where its denominator is."""
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    df = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sweep(scored: DataFrame, high: float = 12.0, step: float = 0.5) -> DataFrame:
    """The counts at thresholds 0, step, ... high over rows (total, is_match), in one pass.

    A row counts at the thresholds it reaches, so its total is first cut down to a number of steps; the counts of all thresholds
    come from that small table, whatever the number of rows.
    """
    n = int(high / step)
    at = F.least(F.greatest(F.floor(F.col("total") / step), F.lit(-1)), F.lit(n)).cast("int")
    level = scored.groupBy(at.alias("level")).agg(F.count_if("is_match").alias("p"), F.count_if(~F.col("is_match")).alias("q"))
    spread = level.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n))))
    hit = F.col("level") >= F.col("t")
    add = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    counts = spread.groupBy("t").agg(add("p", hit).alias("tp"), add("q", hit).alias("fp"), add("p", ~hit).alias("fn"), add("q", ~hit).alias("tn"))
    return with_prf(counts.withColumn("threshold", F.col("t") * step).drop("t"))


def best_thresholds(swept: DataFrame, least_precision: float = 0.85) -> DataFrame:
    """The threshold of the best f1, and of the best among those precise enough; the last of equals."""
    best = lambda cond: F.max(F.when(cond, F.struct("f1", "threshold")))["threshold"]
    return swept.agg(best(F.lit(True)).alias("best"), best(F.col("precision") >= least_precision).alias("best_precise"))


def review_rate(decision: Column) -> Column:
    """The share of pairs that a human would have to look at, as an aggregate; 0 without pairs."""
    return F.coalesce(F.avg((decision == "review").cast("double")), F.lit(0.0)).alias("review_rate")


def report(scored: DataFrame, weights: vocab.Weights | None = None) -> str:
    """An evaluation of rows (total, is_match) as Markdown: both thresholds, the share to review, the best thresholds and the sweep."""
    w = weights or vocab.Weights()
    line = lambda name, r: f"| {name} | {r.precision:.3f} | {r.recall:.3f} | {r.f1:.3f} | {r.tp + r.fp} |"
    at = lambda t: with_prf(scored.agg(*confusion(F.col("total") >= t, F.col("is_match")))).first()
    decision = F.when(F.col("total") >= w.upper, "merge").when(F.col("total") < w.lower, "new").otherwise("review")
    swept = sweep(scored)
    best = best_thresholds(swept).first()
    out = ["# Matcher evaluation", "", "| rule | precision | recall | F1 | pairs |", "|-|-|-|-|-|", line(f"merge (total >= {w.upper:g})", at(w.upper)), line(f"merge or review (total >= {w.lower:g})", at(w.lower)), ""]
    out += [f"review rate: {scored.agg(review_rate(decision)).first()[0]:.1%}; best F1 at {best.best}; best F1 with enough precision at {best.best_precise}", "", "| t | P | R | F1 | TP | FP | FN |", "|-|-|-|-|-|-|-|"]
    out += [f"| {r.threshold:.1f} | {r.precision:.3f} | {r.recall:.3f} | {r.f1:.3f} | {r.tp} | {r.fp} | {r.fn} |" for r in swept.orderBy("threshold").collect()]
    return "\n".join(out) + "\n"


def audit_relations(edges: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    """(edge_id, n_texts, supported) of typed edges: whether any of an edge's source texts grounds it, under any of the ends' names."""
    names = entities.select("entity_id", F.concat(F.array("canonical_name"), "aliases").alias("names"), "entity_type")
    end = lambda side: names.select(*[F.col(c).alias(f"{side}_{c}") for c in names.columns])
    # Kept between steps, so that a step's shuffle files go before those of the next come; texts are joined once for all pairs of an item.
    typed = keep(edges.where("edge_type <> 'mentioned_with'").select("edge_id", "from_id", "to_id", "edge_type", "source_item_ids"))
    known = typed.join(end("a"), F.col("from_id") == F.col("a_entity_id")).drop("from_id", "a_entity_id")
    known = keep(known.join(end("b"), F.col("to_id") == F.col("b_entity_id")).drop("to_id", "b_entity_id"))
    discard(typed)
    fits = F.coalesce(G.types_ok(F.col("edge_type"), F.col("a_entity_type"), F.col("b_entity_type")), F.lit(False))
    rows = known.select("edge_id", "edge_type", "a_names", "b_names", fits.alias("fits"), F.explode_outer("source_item_ids").alias("item_id"))
    texts = items.select("item_id", "raw_text")
    of_item = rows.where("item_id IS NOT NULL").groupBy("item_id").agg(F.collect_list(F.struct("edge_id", "edge_type", "a_names", "b_names", "fits")).alias("pairs"))
    asked = of_item.join(texts, "item_id", "left").withColumn("_low", F.lower("raw_text"))
    name = lambda names: F.coalesce(G.occurring_name(F.col("_low"), names), F.lit(""))
    asked = asked.withColumn("_p", F.transform("pairs", lambda p: F.struct(p["edge_id"].alias("edge_id"), p["edge_type"].alias("edge_type"), p["fits"].alias("fits"), name(p["a_names"]).alias("a"), name(p["b_names"]).alias("b")))).drop("pairs", "_low")
    asked = asked.withColumn("_near", G.near_each(F.coalesce("raw_text", F.lit("")), F.col("_p.a"), F.col("_p.b"), F.col("_p.edge_type")))
    told = asked.select(F.col("raw_text").isNotNull().cast("long").alias("n"), F.explode(F.zip_with("_p", "_near", lambda p, near: F.struct(p["edge_id"].alias("edge_id"), (p["fits"] & near).alias("ok")))).alias("x")).select("n", "x.*")
    told = told.unionByName(rows.where("item_id IS NULL").select("edge_id", F.lit(0).cast("long").alias("n"), F.lit(False).alias("ok")))
    told = keep(told)
    discard(known)
    return told.groupBy("edge_id").agg(F.sum("n").alias("n_texts"), F.bool_or("ok").alias("supported"))


def escalations(edges: DataFrame) -> DataFrame:
    """Edges that a digest puts first: by type, or by weight."""
    return edges.where(F.col("edge_type").isin(*vocab.ESCALATE_TYPES) | (F.col("weight") >= vocab.ESCALATE_WEIGHT))


def geocode(entities: DataFrame, places: DataFrame, names: DataFrame, countries: DataFrame) -> DataFrame:
    """(entity_id, geonameid, lat, lon, place_name, confidence) for location entities with a name that is a country or a place.

    A country stands for its capital (confidence 0.9); a place for the most populous of its name (0.8, or 0.6 if there are several);
    the part before a comma counts at 0.8 of that. The best of an entity's names wins, the first of equals.
    places: geonameid, name, lat, lon, country, feature_code, population. names: name_norm, geonameid. countries: iso, name_norm, capital.
    """
    asked = entities.where("entity_type = 'location' AND is_live").select("entity_id", F.posexplode(F.concat(F.array("canonical_name"), "aliases")).alias("ord", "raw"))
    head = F.trim(F.substring_index("raw", ",", 1))
    whole = asked.select("entity_id", "ord", F.col("raw").alias("name"), F.lit(1.0).alias("factor"))
    asked = whole.unionByName(asked.where(F.col("raw").contains(",") & (F.octet_length(head) >= 3)).select("entity_id", "ord", head.alias("name"), F.lit(0.8).alias("factor")))
    synonyms = F.create_map(*[F.lit(x) for kv in vocab.COUNTRY_SYNONYMS.items() for x in kv])
    asked = asked.withColumn("norm", T.normalize(F.col("name"))).withColumn("country_norm", F.coalesce(F.try_element_at(synonyms, F.col("norm")), F.col("norm")))
    order = F.struct("population", (-F.col("geonameid")).alias("tie"))
    capital = places.where("feature_code = 'PPLC'").groupBy(F.col("country").alias("iso")).agg(F.max_by(F.struct("geonameid", "lat", "lon", "name"), order).alias("p"))
    by_name = countries.drop("name").join(names.select(F.col("name_norm").alias("capital_norm"), "geonameid"), T.normalize(F.col("capital")) == F.col("capital_norm")).join(places, "geonameid").where(F.col("country") == F.col("iso")).groupBy("iso").agg(F.max_by(F.struct("geonameid", "lat", "lon", "name"), order).alias("q"))
    country = countries.join(capital, "iso", "left").join(by_name, "iso", "left").select(F.col("name_norm").alias("country_norm"), F.coalesce("p", "q").alias("at")).where("at IS NOT NULL")
    country_hit = asked.join(country, "country_norm").select("entity_id", "ord", "factor", "at", F.lit(0.9).alias("conf"), F.lit(0).alias("kind"))
    place = names.join(places, "geonameid").groupBy("name_norm").agg(F.max_by(F.struct("geonameid", "lat", "lon", "name"), order).alias("at"), F.countDistinct("geonameid").alias("n"))
    place_hit = asked.join(place, F.col("norm") == F.col("name_norm")).select("entity_id", "ord", "factor", "at", F.when(F.col("n") == 1, 0.8).otherwise(0.6).alias("conf"), F.lit(1).alias("kind"))
    # For one name: as a whole before its head, as a country before a place.
    first = country_hit.unionByName(place_hit).groupBy("entity_id", "ord").agg(F.max_by(F.struct("at", (F.col("conf") * F.col("factor")).alias("conf")), F.struct("factor", (-F.col("kind")).alias("k"))).alias("hit"))
    best = first.groupBy("entity_id").agg(F.max_by("hit", F.struct("hit.conf", (-F.col("ord")).alias("o"))).alias("hit"))
    return best.select("entity_id", "hit.at.geonameid", "hit.at.lat", "hit.at.lon", F.col("hit.at.name").alias("place_name"), F.round("hit.conf", 6).alias("confidence"))


def features_geojson(geo: DataFrame) -> DataFrame:
    """One GeoJSON feature per row (entity_id, canonical_name, entity_type, lat, lon, confidence)."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), F.col("entity_type").alias("type"), "confidence")
    return geo.select("entity_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))).alias("feature"))
