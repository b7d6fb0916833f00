"""The scorer: evidence of a mention for a candidate, as a struct of its total and its contributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import matching as M
from kinweave.functions import similarity as S
from kinweave.functions import text as T


def decide(total: Column, w: vocab.Weights) -> Column:
    """merge, review or new."""
    return F.when(total >= w.upper, "merge").when(total < w.lower, "new").otherwise("review")


def _pick(values: tuple, level: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), level)


def score(pairs: DataFrame, weights: vocab.Weights | None = None, phonetics: bool = True) -> DataFrame:
    """Adds `total`, `contributions` (name, weight of those that are not 0) and `decision` to pairs.

    pairs: mention, mention_type, canonical, aliases (array), entity_type, cooc (double), corroboration (long), recent (boolean).
    phonetics=False leaves the phonetic feature out, for comparison with engines that have none. Steps are projections, so that
    Spark evaluates each feature once; Python runs for Jaro-Winkler and for the codes only.
    """
    w = weights or vocab.Weights()
    df = pairs.withColumn("_m", T.normalize(F.col("mention")))
    df = df.withColumn("_names", F.filter(F.concat(F.array(T.normalize(F.col("canonical"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.normalize)), lambda n: n != ""))
    df = df.withColumn("_mt", T.content_tokens(F.col("_m"))).withColumn("_tokens", F.transform("_names", T.content_tokens))
    flat = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    df = df.withColumn("_compact", (F.col("_m") != "") & ~F.array_contains("_names", F.col("_m")) & (F.octet_length(flat(F.col("_m"))) >= 4) & F.exists("_names", lambda n: flat(n) == flat(F.col("_m"))))
    df = df.withColumn("_exact", F.array_contains("_names", F.col("_m")) | F.col("_compact"))
    df = df.withColumn("_jw", S.jaro_winkler_best(F.col("_m"), F.col("_names")))
    # The name with most words in common; of equals the last.
    ranked = F.transform("_tokens", lambda t, i: F.struct(M.jaccard(F.col("_mt"), t).alias("j"), i.alias("i")))
    df = df.withColumn("_best", F.array_max(ranked)).withColumn("_ct", F.coalesce(F.get("_tokens", F.col("_best.i")), F.array().cast("array<string>")))
    df = df.withColumn("_j", F.coalesce("_best.j", F.lit(0.0))).withColumn("_extra", M.extra_tokens(F.col("_mt"), F.col("_ct"))).withColumn("_subset", M.subset_level(F.col("_mt"), F.col("_ct")))
    if phonetics:
        df = df.withColumn("_phon", M.phonetic_level(S.phonetic_codes(F.col("_mt")), S.phonetic_codes(F.col("_ct"))))
    df = df.withColumn("_type", M.type_level(F.col("mention_type"), F.col("entity_type")))
    df = df.withColumn("_acr", F.when(F.col("_exact"), 0).otherwise(M.acronym_level(F.col("mention"), F.col("_mt"), F.col("canonical"), T.content_tokens(T.normalize(F.col("canonical"))))))
    level = F.when(F.col("_jw") >= 0.95, 3).when(F.col("_jw") >= 0.87, 2).when(F.col("_jw") >= 0.75, 1).otherwise(0)
    level = F.when(F.col("_extra") > 0, F.least(level, F.lit(2))).otherwise(level)
    level = F.when(F.col("_subset") >= 1, F.greatest(level, F.lit(1))).otherwise(level)
    full = ~(F.col("_acr") == 1) & ~F.col("_compact")
    only = lambda cond, v: F.when(cond, v).otherwise(0.0)
    evidence = [
        ("acronym_match", only(F.col("_acr") == 1, w.acronym_match)),
        ("name_jw", F.when(F.col("_acr") == 1, 0.0).when(F.col("_compact"), w.name[3]).otherwise(_pick(w.name, level))),
        ("alias_exact", only(~(F.col("_acr") == 1) & F.col("_exact"), w.alias_exact)),
        ("token_jaccard", only(full, _pick(w.jaccard, F.when(F.col("_j") >= 0.8, 2).when(F.col("_j") >= 0.5, 1).otherwise(0)))),
        *([("phonetic", only(full, _pick(w.phonetic, F.col("_phon"))))] if phonetics else []),
        ("extra_tokens", only(full, _pick(w.extra_tokens, F.least(F.col("_extra"), F.lit(2))))),
        ("token_subset", only(full, _pick(w.token_subset, F.col("_subset")))),
        ("acronym_mismatch", only(full & (F.col("_acr") == -1), w.acronym_mismatch)),
        ("type_agree", _pick(w.type_agree, F.col("_type"))),
    ]
    df = df.withColumns({f"_e_{name}": c for name, c in evidence})
    df = df.withColumn("_evidence", sum((F.col(f"_e_{name}") for name, _ in evidence), F.lit(0.0)))
    raw = {"cooc": _pick(w.cooc, F.when(F.col("cooc") >= 0.5, 2).when(F.col("cooc") > 0, 1).otherwise(0)), "corroboration": _pick(w.corroboration, F.when(F.col("corroboration") >= 8, 3).when(F.col("corroboration") >= 3, 2).when(F.col("corroboration") >= 1, 1).otherwise(0)), "recent": F.when(F.col("recent"), w.recent).otherwise(0.0)}
    df = df.withColumns({f"_p_{k}": F.when(F.col("_evidence") >= w.lower, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for k, c in raw.items()})
    prior = F.col("_p_cooc") + F.col("_p_corroboration") + F.col("_p_recent")
    scale = F.when(prior > w.prior_cap, w.prior_cap / prior).otherwise(1.0)
    parts = [(name, F.col(f"_e_{name}")) for name, _ in evidence] + [(k, F.col(f"_p_{k}") * scale) for k in raw]
    listed = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("weight")) for n, v in parts]), lambda c: c["weight"] != 0)
    df = df.withColumn("contributions", listed).withColumn("total", F.col("_evidence") + prior * scale).withColumn("decision", decide(F.col("total"), w))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def best_candidates(scored: DataFrame, decorrelations: DataFrame | None = None, weights: vocab.Weights | None = None, gap: float = 3.0) -> DataFrame:
    """The best candidate of each mention_id: highest total, then blocking order (hits, entity_id).

    scored: mention_id, entity_id, hits, total, contributions. A merge whose winner is known to differ (a_id, b_id) from a candidate
    within `gap` of it becomes a review: its total is half a point under the upper threshold.
    """
    w = weights or vocab.Weights()
    order = Window.partitionBy("mention_id").orderBy(F.col("total").desc(), F.col("hits").desc(), "entity_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    top = ranked.where("rank = 1").drop("rank")
    if decorrelations is not None:
        rivals = ranked.where("rank > 1").select("mention_id", F.col("entity_id").alias("rival_id"), F.col("total").alias("rival_total"))
        close = top.where(F.col("total") >= w.upper).join(rivals, "mention_id").where(F.col("total") - F.col("rival_total") < gap)
        close = close.select("mention_id", F.least("entity_id", "rival_id").alias("a_id"), F.greatest("entity_id", "rival_id").alias("b_id"))
        vetoed = close.join(decorrelations.select("a_id", "b_id"), ["a_id", "b_id"], "left_semi").select("mention_id").distinct().withColumn("vetoed", F.lit(True))
        top = top.join(vetoed, "mention_id", "left")
        mark = F.struct(F.lit("decorrelation_veto").alias("name"), (F.lit(w.upper - 0.5) - F.col("total")).alias("weight"))
        top = top.withColumn("contributions", F.when(F.col("vetoed"), F.concat("contributions", F.array(mark))).otherwise(F.col("contributions")))
        top = top.withColumn("total", F.when(F.col("vetoed"), w.upper - 0.5).otherwise(F.col("total"))).drop("vetoed")
    return top.withColumn("decision", decide(F.col("total"), w))
