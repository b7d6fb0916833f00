"""What a question, a dossier or a trace needs to know; a model's words are left to a function passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.operators import graph, temporal


def seeds(entities: DataFrame, question: str, least: float = 0.9, most: int = 6) -> DataFrame:
    """(entity_id, score) of the entities that a question names, best first: word for word, or nearly so for names of several words.

    Short names in capitals count only where the question writes them so.
    """
    q, raw = F.lit(question.lower()), F.lit(question)
    names = entities.select("entity_id", "canonical_name", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name")).withColumn("n", F.lower(F.trim("name")))
    capital = (F.octet_length(F.trim("name")) <= 4) & ~F.trim("name").rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]")
    words = T.question_words(F.lit(question))
    k = F.size(F.filter(F.split("n", r"\s+"), lambda w: w != ""))
    fuzzy = F.when((k >= 2) & (F.octet_length("n") >= 3), S.jaro_winkler_best(F.col("n"), T.ngrams(words, k))).otherwise(0.0)
    hit = T.contains_word(q, F.col("n"))
    score = F.when(capital & T.contains_word(raw, F.trim("name")), 1.0).when(F.octet_length("n") < 3, 0.0).when(hit & ~capital, 1.0).when(hit, 0.0).otherwise(fuzzy)
    best = names.withColumn("score", score).groupBy("entity_id", "canonical_name").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    return best.orderBy(F.col("score").desc(), F.octet_length("canonical_name").desc(), "entity_id").limit(most).select("entity_id", "score")


def ask(question: str, entities: DataFrame, edges: DataFrame, items: DataFrame, as_of=None, license_class: str | None = None, complete: Callable[[str, str], str] | None = None) -> dict:
    """The slice of the graph that bears on a question, with numbered sources, and an answer if there is someone to write it.

    Seeds are the entities named; without any, hubs of the relations asked for, else hubs. The walk goes two hops, edges are ranked,
    limited to a licence if one is given, and cited by number. An answer without citations is marked.
    """
    spark = entities.sparkSession
    wanted = spark.range(1).select(T.relation_intents(F.lit(question)).alias("x")).first().x
    valid = temporal.valid_now(edges) if as_of is None else temporal.as_of(edges, as_of)
    start = seeds(entities if as_of is not None else entities.where("is_live"), question).select("entity_id")
    if start.isEmpty():
        start = graph.hubs(edges, 6, wanted).select("entity_id") if wanted else start
        start = graph.hubs(edges, 6).select("entity_id") if start.isEmpty() else start
    elif wanted:
        start = start.unionByName(graph.hubs(edges, 3, wanted).select("entity_id")).distinct()
    slice_ = valid.join(graph.neighbourhood(valid, start), "edge_id")
    if license_class:
        slice_ = graph.license_filter(slice_, items, license_class)
    ranked = graph.ranked_slice(slice_, wanted)
    sources = graph.source_numbers(ranked, items)
    names = entities.select("entity_id", "canonical_name")
    cited = ranked.select("edge_id", F.explode("source_item_ids").alias("item_id")).join(sources.select("item_id", "number"), "item_id").groupBy("edge_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("number")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "").alias("cites"))
    lines = ranked.join(names.select(F.col("entity_id").alias("from_id"), F.col("canonical_name").alias("a")), "from_id").join(names.select(F.col("entity_id").alias("to_id"), F.col("canonical_name").alias("b")), "to_id").join(cited, "edge_id", "left")
    lines = lines.select("rank", F.concat_ws(" ", "a", "edge_type", "b", F.date_format("valid_at", "yyyy-MM-dd"), "cites").alias("line")).orderBy("rank")
    out = {"seeds": start, "edges": ranked, "sources": sources, "lines": lines, "answer": None}
    if complete:
        context = "\n".join(r.line for r in lines.collect())  # at most 60 lines
        refs = [r.source_ref for r in sources.select("source_ref").collect()]
        text = complete(context, question)
        out["answer"] = spark.range(1).select(T.flag_uncited(F.lit(text), T.strings(refs) if refs else F.array().cast("array<string>")).alias("x")).first().x
    return out


def find_entity(entities: DataFrame, name: str) -> DataFrame:
    """The entity of an id, else of a name (whatever the case, the most certain first): no row if there is none."""
    rank = F.when(F.col("entity_id") == name, 0).when(F.lower("canonical_name") == name.lower(), 1)
    return entities.withColumn("_r", rank).where("_r IS NOT NULL").orderBy("_r", F.col("confidence").desc(), "entity_id").limit(1).drop("_r")


def why(entity_id: str, candidates: DataFrame, items: DataFrame, edges: DataFrame, decisions: DataFrame, decorrelations: DataFrame) -> dict[str, DataFrame]:
    """Where what is known of an entity comes from: mentions, relations, decisions, and whom it is not."""
    mentions = candidates.where(F.col("entity_id") == entity_id).join(items.drop("status"), "item_id").withColumn("tier", F.when(F.col("status") == "resolved", "tier 2").otherwise("tier 1"))
    relations = edges.where((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id)).orderBy(F.col("edge_type") == "mentioned_with", F.col("weight").desc(), "edge_id")
    decided = decisions.join(candidates.where(F.col("entity_id") == entity_id).select("candidate_id", "mention_text"), "candidate_id").orderBy("decided_at", "candidate_id")
    return {"mentions": mentions, "relations": relations, "decisions": decided, "not_the_same": decorrelations.where((F.col("a_id") == entity_id) | (F.col("b_id") == entity_id))}


def dossier(entity_id: str, entities: DataFrame, edges: DataFrame, items: DataFrame, as_of=None) -> dict[str, DataFrame]:
    """An entity's one-hop slice as a timeline of typed relations, a network of the heaviest co-mentions, and numbered sources."""
    spark = entities.sparkSession
    valid = temporal.valid_now(edges) if as_of is None else temporal.as_of(edges, as_of)
    near = valid.join(graph.neighbourhood(valid, spark.range(1).select(F.lit(entity_id).alias("entity_id")), 1), "edge_id")
    ranked = graph.ranked_slice(near, [])
    network = near.where("edge_type = 'mentioned_with'").orderBy(F.col("weight").desc(), "edge_id").limit(15)
    return {"entity": entities.where(F.col("entity_id") == entity_id), "timeline": graph.timeline(near, entity_id), "network": network, "sources": graph.source_numbers(ranked, items)}


def digest(entities: DataFrame, edges: DataFrame, candidates: DataFrame, started) -> dict[str, DataFrame]:
    """What is new since a time: counts, the heaviest new typed relations, and those to escalate."""
    names = entities.select("entity_id", "canonical_name")
    new = temporal.valid_now(edges).where((F.col("first_seen") >= started) & (F.col("edge_type") != "mentioned_with"))
    new = new.join(names.select(F.col("entity_id").alias("from_id"), F.col("canonical_name").alias("a")), "from_id").join(names.select(F.col("entity_id").alias("to_id"), F.col("canonical_name").alias("b")), "to_id").orderBy(F.col("weight").desc(), "edge_id").limit(200)
    urgent = new.where(F.col("edge_type").isin(*vocab.ESCALATE_TYPES) | (F.col("weight") >= vocab.ESCALATE_WEIGHT))
    counts = entities.agg(F.count_if(F.col("first_seen") >= started).alias("new_entities")).join(candidates.agg(F.count_if(F.col("status") == "pending_review").alias("pending_review")))
    return {"counts": counts, "new": new, "escalations": urgent}


def render_digest(counts: dict, escalations: list[str], relations: list[str], quakes: list[str]) -> str:
    """A digest as Markdown, escalations first; a cycle without news says so."""
    out = ["# Digest", "", f"new entities: {counts.get('new_entities', 0)}, pending review: {counts.get('pending_review', 0)}"]
    for title, lines, most in (("Escalations", escalations, 60), ("New relations", relations, 60), ("Quakes", quakes, 20)):
        if lines:
            out += ["", f"## {title}", *[f"- {x}" for x in lines[:most]]]
    return "\n".join(out if escalations or relations or quakes else [*out, "", "Nothing new."]) + "\n"
