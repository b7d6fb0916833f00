"""Resolution of mentions to entities: against those known, then among themselves in order of arrival."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import text as T
from kinweave.operators import blocking, scoring, temporal
from kinweave.operators.kept import keep as _keep


def extract(items: DataFrame) -> DataFrame:
    """(mention_id, item_id, mention_text, mention_type, observed_at, start, score) of items (item_id, raw_text, observed_at)."""
    m = _keep(items.select("item_id", "observed_at", F.explode(T.mentions(F.col("raw_text"))).alias("m")).select("item_id", "observed_at", "m.text", "m.start", "m.score"))
    return m.select(F.sha2(F.concat_ws("|", "item_id", F.col("start").cast("string")), 256).alias("mention_id"), "item_id", F.col("text").alias("mention_text"), F.lit(None).cast("string").alias("mention_type"), "observed_at", "start", "score")


#: Rows up to which a table goes to all executors.
SMALL = 20_000


def _small(df: DataFrame) -> DataFrame:
    """A kept table, broadcast if it has few rows: what it is joined with is then not shuffled."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _may_merge(m: Column, e: Column, w: vocab.Weights) -> Column:
    """Whether forms (words, flat, acronym) can reach a merge: without a common word, as other spellings or as short form and long,
    they have no more than the evidence summed here."""
    most = max(w.name[:3]) + w.jaccard[0] + max(0.0, *w.phonetic) + w.extra_tokens[2] + w.token_subset[0] + max(0.0, w.acronym_mismatch) + max(w.type_agree) + max(0.0, w.prior_cap)
    if most >= w.upper:
        return F.lit(True)
    short = (m["acronym"] & (F.size(e["words"]) >= 2)) | (e["acronym"] & (F.size(m["words"]) >= 2))
    return F.arrays_overlap(m["words"], e["words"]) | (m["flat"] == e["flat"]) | short


def _earlier_merges(forms: DataFrame, weights: vocab.Weights, phonetics: bool) -> DataFrame:
    """(form_id, earlier_id, total): forms that would merge with a form that came first, if that were an entity."""
    norm = T.normalize(F.col("mention_text"))
    what = F.struct(F.col("form_id").alias("id"), F.replace(norm, F.lit(" "), F.lit("")).alias("flat"), T.is_acronym(F.col("mention_text")).alias("acronym"), T.content_tokens(norm).alias("words"))
    keys = _keep(blocking.index(forms.select(what.alias("entity_id"), F.col("mention_text").alias("name")), phonetics=phonetics))
    pairs = blocking.candidates(keys.withColumnRenamed("entity_id", "mention_id"), keys, keep=lambda m, e: _may_merge(m, e, weights) & (m["id"] != e["id"]))
    pairs = _keep(pairs.select(F.col("mention_id.id").alias("mention_id"), F.col("entity_id.id").alias("entity_id")))
    left = forms.select(F.col("form_id").alias("mention_id"), F.col("mention_text").alias("mention"), "mention_type", F.col("first").alias("f"))
    right = forms.select(F.col("form_id").alias("entity_id"), F.col("mention_text").alias("canonical"), F.coalesce("mention_type", F.lit("unknown")).alias("entity_type"), F.col("first").alias("g"))
    rows = pairs.join(left, "mention_id").join(right, "entity_id").where("g < f")
    rows = rows.withColumns({"aliases": F.array().cast("array<string>"), "cooc": F.lit(0.0), "corroboration": F.lit(0).cast("long"), "recent": F.lit(True)})
    # Kept first: a condition on the decision would be pushed down through all steps of the score, and grow with each.
    scored = _keep(scoring.score(rows, weights, phonetics).select(F.col("mention_id").alias("form_id"), F.col("entity_id").alias("earlier_id"), "total", "decision"))
    return scored.where("decision = 'merge'").drop("decision")


def first_roots(forms: DataFrame, merges: DataFrame) -> DataFrame:
    """(form_id, root_id): each form goes to the best earlier form that is a root; a form whose merging predecessors are all taken
    elsewhere, or that has none, is a root. Rounds settle forms whose predecessors are settled, so they follow the order of arrival, and
    each settles the first of those that wait at least."""
    waiting = _keep(merges)
    free = forms.select("form_id").join(waiting.select("form_id").distinct(), "form_id", "left_anti").select("form_id", F.col("form_id").alias("root_id"))
    known = _keep(free.join(waiting.select(F.col("earlier_id").alias("form_id")).distinct(), "form_id", "left_semi"))  # no other can be asked for
    settled = [free]
    while not waiting.isEmpty():
        status = waiting.join(known.select(F.col("form_id").alias("earlier_id"), "root_id"), "earlier_id", "left")
        ready = status.groupBy("form_id").agg(F.bool_and(F.col("root_id").isNotNull()).alias("settled"), F.max_by("earlier_id", F.when(F.col("root_id") == F.col("earlier_id"), F.struct("total", F.xxhash64("earlier_id")))).alias("best"), F.max(F.when(F.col("root_id") == F.col("earlier_id"), 1)).alias("has"))
        done = _keep(ready.where("settled").select("form_id", F.when(F.col("has") == 1, F.col("best")).otherwise(F.col("form_id")).alias("root_id")))
        settled.append(done)
        known = _keep(known.unionByName(done))
        waiting = _keep(waiting.join(done.select("form_id"), "form_id", "left_anti"))
    return reduce(DataFrame.unionByName, settled)


def _forms(mentions: DataFrame) -> DataFrame:
    """Written forms (form_id, mention_text, mention_type, first, score) of mentions."""
    forms = mentions.groupBy("mention_text", "mention_type").agg(F.min(F.struct("observed_at", "item_id", "start")).alias("first"), F.max("score").alias("score"))
    return forms.withColumn("form_id", F.sha2(F.concat_ws("|", F.lit("form"), "mention_text", F.coalesce("mention_type", F.lit(""))), 256))


def _in_context(mentions: DataFrame, forms: DataFrame, best: DataFrame, rows: DataFrame, edges: DataFrame, decorrelations: DataFrame | None, w: vocab.Weights, phonetics: bool) -> DataFrame:
    """(own_id, form_id, entity_id, total, decision) of mentions that merge, or come to be reviewed, only by their context.

    Context is the entities that earlier mentions of the item have merged with: the share of them that a candidate has an edge with
    is scored too, for the mentions whose form alone did not merge.
    """
    asked = _keep(forms.join(best.select(F.col("mention_id").alias("form_id"), F.col("entity_id").alias("with"), "decision"), "form_id").select("form_id", F.col("mention_text").alias("_t"), F.col("mention_type").alias("_y"), "with", "decision"))
    judged = _keep(mentions.join(_small(asked), (F.col("mention_text") == F.col("_t")) & F.col("mention_type").eqNullSafe(F.col("_y"))).select(F.col("mention_id").alias("own_id"), "item_id", "start", "form_id", "with", "decision"))
    before = judged.where("decision = 'merge'").select("item_id", F.col("start").alias("at"), "with")
    open_ = judged.where("decision <> 'merge'").select("own_id", "item_id", "start", "form_id", F.col("decision").alias("alone"))
    context = open_.join(before, "item_id").where("at < start").groupBy("own_id", "form_id", "alone").agg(F.collect_set("with").alias("other_ids"))
    pairs = context.join(rows.drop("cooc"), F.col("form_id") == F.col("mention_id")).withColumn("pair_id", F.concat_ws("|", "own_id", "entity_id"))
    near = blocking.cooc_fraction(pairs.select("pair_id", "entity_id", "other_ids"), edges)
    scored = scoring.score(pairs.drop("mention_id").join(near, "pair_id").withColumn("mention_id", F.col("own_id")), w, phonetics)
    again = scoring.best_candidates(scored.select("mention_id", "entity_id", "hits", "total", "contributions"), decorrelations, w)
    told = again.where("decision <> 'new'").select(F.col("mention_id").alias("own_id"), "entity_id", "total", "decision")
    return told.join(context.select("own_id", "form_id", "alone"), "own_id").where("decision <> alone").drop("alone")


def resolve(mentions: DataFrame, entities: DataFrame, now, candidates: DataFrame | None = None, decorrelations: DataFrame | None = None, weights: vocab.Weights | None = None, phonetics: bool = True, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """A batch of mentions as candidates, new entities, edges and item states.

    Names are scored once per written form. Forms that merge with or need review against a known entity go to it. The rest are
    scored among themselves: the form that came first becomes the entity that later forms merge with. The first mention of a new
    entity needs a second look (needs_llm), all later ones are merged. With edges given, a mention whose form alone does not merge is
    scored once more, with the entities that earlier mentions of its item merged with as evidence. Mentions of one item are linked in
    order of their entities.
    """
    w = weights or vocab.Weights()
    forms = _keep(_forms(mentions))
    names = entities.select("entity_id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("name"))
    mention_keys = blocking.index(forms.select("form_id", F.col("mention_text").alias("name")), "form_id", phonetics).withColumnRenamed("form_id", "mention_id")
    pairs = blocking.candidates(mention_keys, blocking.index(names, phonetics=phonetics))
    support = blocking.corroboration(candidates) if candidates is not None else None
    rows = pairs.join(forms.select(F.col("form_id").alias("mention_id"), F.col("mention_text").alias("mention"), "mention_type"), "mention_id")
    rows = rows.join(entities.select("entity_id", F.col("canonical_name").alias("canonical"), "aliases", "entity_type", (F.col("last_seen") > now - F.expr(f"INTERVAL {vocab.LIVE_DAYS} DAYS")).alias("recent")), "entity_id")
    rows = rows.join(support.withColumnRenamed("n", "corroboration"), "entity_id", "left") if support is not None else rows.withColumn("corroboration", F.lit(None).cast("long"))
    rows = _keep(rows.withColumns({"cooc": F.lit(0.0), "corroboration": F.coalesce("corroboration", F.lit(0).cast("long"))}))
    best = _keep(scoring.best_candidates(scoring.score(rows, w, phonetics).select("mention_id", "entity_id", "hits", "total", "contributions"), decorrelations, w))
    known = best.where("decision <> 'new'").select(F.col("mention_id").alias("form_id"), "entity_id", "total", "decision")
    told = _keep(_in_context(mentions, forms, best, rows, edges, decorrelations, w, phonetics)) if edges is not None else None
    told = None if told is None or told.isEmpty() else told
    left = forms
    if told is not None:  # forms with such mentions start anew without them
        moved = _keep(forms.join(told.select("form_id").distinct(), "form_id", "left_semi"))
        theirs = mentions.join(_small(moved.select(F.col("mention_text").alias("_t"), F.col("mention_type").alias("_y"))), (F.col("mention_text") == F.col("_t")) & F.col("mention_type").eqNullSafe(F.col("_y"))).drop("_t", "_y")
        left = forms.join(moved, "form_id", "left_anti").unionByName(_forms(theirs.join(told, F.col("mention_id") == F.col("own_id"), "left_anti")))
    rest = _keep(left.join(known.select("form_id"), "form_id", "left_anti"))
    roots = first_roots(rest, _earlier_merges(rest, w, phonetics))
    entity_of = F.sha2(F.concat_ws("|", F.lit("entity"), "root_id"), 256)
    fresh = _keep(roots.select("form_id", "root_id", entity_of.alias("entity_id")))
    firsts = fresh.join(forms.select(F.col("form_id").alias("root_id"), F.col("first").alias("root_first")), "root_id").select("form_id", "entity_id", "root_first")
    placed = known.select("form_id", "entity_id", "total", "decision", F.lit(None).cast(forms.schema["first"].dataType).alias("root_first"))
    placed = placed.unionByName(firsts.select("form_id", "entity_id", F.lit(None).cast("double").alias("total"), F.lit("new").alias("decision"), "root_first"))
    placed = _keep(forms.select("form_id", F.col("mention_text").alias("_t"), F.col("mention_type").alias("_y")).join(placed, "form_id", "left").drop("form_id"))
    out = mentions.join(placed, (F.col("mention_text") == F.col("_t")) & F.col("mention_type").eqNullSafe(F.col("_y"))).drop("_t", "_y")
    if told is not None:
        news = _small(told).select("own_id", *[F.col(c).alias(f"_{c}") for c in ("entity_id", "total", "decision")])
        out = out.join(news, F.col("mention_id") == F.col("own_id"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("entity_id", "total", "decision")})
    opens = F.struct("observed_at", "item_id", "start") == F.col("root_first")
    status = F.when(F.col("decision") == "merge", "auto_merged").when(F.col("decision") == "review", "pending_review").when(opens, "needs_llm").otherwise("auto_merged")
    made = out.select(F.col("mention_id").alias("candidate_id"), "item_id", "mention_text", "mention_type", "entity_id", F.col("total").alias("match_score"), status.alias("status"), "observed_at")
    new = rest.join(fresh.where("form_id = root_id"), "form_id").select("entity_id", F.col("mention_text").alias("canonical_name"), F.coalesce("mention_type", F.lit("unknown")).alias("entity_type"), F.greatest(F.lit(0.3), F.least("score", F.lit(0.9))).alias("confidence"))
    links = temporal.adjacent_pairs(made).join(made.groupBy("item_id").agg(F.min("observed_at").alias("observed_at")), "item_id").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("mentioned_with").alias("edge_type"), "item_id", "observed_at", F.unix_micros(F.col("observed_at").cast("timestamp")).alias("seq"))
    states = made.groupBy("item_id").agg(F.when(F.bool_or(F.col("status").isin("needs_llm", "pending_review")), "needs_llm").otherwise("resolved").alias("status"))
    return {"candidates": made, "entities": new, "edges": temporal.accumulate(links), "items": states, "stats": made.groupBy("status").agg(F.count("*").alias("n"))}
