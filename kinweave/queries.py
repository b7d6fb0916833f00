"""One query per operator over whole tables, and for most of them the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave import vocab
from kinweave.functions import matching as M
from kinweave.functions import recover as R
from kinweave.functions import similarity as S
from kinweave.functions import text as T
from kinweave.operators import answer, blocking, enrich, evaluate, graph, listing, resolve, scoring, state, temporal
from kinweave.plans import domain as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# ---- the domain's tables in SQL ------------------------------------------------------------------------------------------------

QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
NAME = r"\b([A-Z][a-zA-Z0-9&\-]*(?:\s+[A-Z][a-zA-Z0-9&\-]*){0,3})\b"
ASCII_ONLY = r"regexp_replace(text, '[^\x00-\x7F\pZ\pP\pS]', '_', 'g')"
MENTIONS = rf"""mentions AS (
    SELECT DISTINCT doc_id, lower(m) AS mention FROM (SELECT doc_id, unnest(regexp_extract_all({ASCII_ONLY}, '{NAME}', 1)) AS m FROM documents) WHERE regexp_matches(m, '\s') OR strlen(m) >= 3)"""
CANDIDATES = MENTIONS + """, candidates AS (
    SELECT 'doc' || doc_id || '|' || mention AS candidate_id, 'doc' || doc_id AS item_id, mention AS mention_text, mention AS entity_id, doc_id % 8 / 1.0::DOUBLE AS match_score,
        ['auto_merged', 'pending_review', 'needs_llm', 'resolved', 'confirmed'][doc_id % 5 + 1] AS status FROM mentions)"""
ITEMS = """items AS (
    SELECT 'doc' || doc_id AS item_id, source AS source_type, source AS source_ref, sha256(source || '|' || text) AS content_hash, 'title' AS title, text AS raw_text,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS published_at_hours, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * doc_id AS published_at,
        CASE doc_id % 3 WHEN 0 THEN 'commercial_clean' WHEN 1 THEN 'noncommercial' ELSE 'unknown' END AS license_class, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'resolved' END AS status, doc_id FROM documents)"""
ENTITIES = """raw_entities AS (
    SELECT 'product:' || p_name AS entity_id, 'product' AS entity_type, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS canonical_name, min(p_partkey) AS k, NULL::TIMESTAMP AS seen FROM part GROUP BY p_name
    UNION ALL SELECT 'organization:' || s_suppkey, 'organization', s_name, s_suppkey, NULL FROM supplier
    UNION ALL SELECT 'location:' || n_name, 'location', list_aggregate(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), n_nationkey, NULL FROM nation
    UNION ALL SELECT 'person:' || user_id, 'person', 'User ' || user_id, user_id, max(ts) FROM events GROUP BY user_id
), entities AS (
    SELECT entity_id, entity_type, canonical_name, k % 10 / 10.0::DOUBLE AS confidence, coalesce(seen, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (k % 60)) AS last_seen, k % 7 <> 0 AS is_live,
        coalesce(seen, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (k % 60)) + INTERVAL 30 DAY AS expiry_time FROM raw_entities)"""
EDGES = """raw_edges AS (
    SELECT 'c' || c_custkey AS from_id, 'n' || c_nationkey AS to_id, 'based_in' AS edge_type, c_custkey % 4 / 1.0::DOUBLE AS weight, c_custkey AS k FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'headquartered_in', s_suppkey % 4 / 1.0::DOUBLE, s_suppkey FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'mentioned_with', 1.0::DOUBLE, n_nationkey FROM nation
), edges AS (
    SELECT edge_type || '|' || from_id || '|' || to_id AS edge_id, from_id, to_id, edge_type, weight, ['doc' || (k % 100), 'doc' || ((k + 1) % 100)] AS source_item_ids,
        TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (k % 30) AS valid_at, CASE WHEN k % 3 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (k % 30 + 20) END AS invalid_at FROM raw_edges)"""
OBSERVATIONS = """observations AS (
    SELECT 'part:' || l_partkey AS from_id, 'supplier:' || l_suppkey AS to_id, 'owned_by' AS edge_type, 'order' || l_orderkey AS item_id, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""
NORM = lambda x: rf"trim(regexp_replace(replace(lower({x}), '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
WORDS = lambda x: f"list_filter(string_split({x}, ' '), lambda t: t <> '')"
CONTENT = lambda x: f"CASE WHEN len(list_filter({WORDS(x)}, lambda t: t NOT IN ({QUOTED(vocab.IGNORABLE)}))) = 0 THEN {WORDS(x)} ELSE list_filter({WORDS(x)}, lambda t: t NOT IN ({QUOTED(vocab.IGNORABLE)})) END"
PAIRS = """names AS (SELECT DISTINCT list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS name FROM part),
ways AS (SELECT DISTINCT unnest([name, upper(name), replace(name, ' ', '.'), array_to_string(list_reverse(string_split(name, ' ')), ' '), name || ' Inc', left(name, length(name) - 1), replace(name, ' ', '')]) AS mention FROM names),
name_pairs AS (SELECT DISTINCT mention, name AS canonical FROM (SELECT mention, unnest(string_split(lower(replace(mention, '.', ' ')), ' ')) AS w FROM ways) m JOIN (SELECT name, unnest(string_split(lower(name), ' ')) AS w FROM names) c USING (w))"""
FEATURES = f"""{PAIRS}, n AS (SELECT *, {NORM('mention')} AS m, {NORM('canonical')} AS c FROM name_pairs), t AS (SELECT *, {CONTENT('m')} AS mt, {CONTENT('c')} AS ct FROM n),
f AS (
    SELECT *, len(list_intersect(list_distinct(mt), list_distinct(ct))) / len(list_distinct(list_concat(mt, ct)))::DOUBLE AS jaccard, CASE WHEN len(mt) <= len(ct) THEN mt ELSE ct END AS short, CASE WHEN len(mt) <= len(ct) THEN ct ELSE mt END AS long,
        len(list_filter(list_distinct(mt), lambda x: NOT list_contains(ct, x))) + len(list_filter(list_distinct(ct), lambda x: NOT list_contains(mt, x))) AS extra, jaro_winkler_similarity(m, c) AS jw FROM t
), g AS (
    SELECT *, CASE WHEN len(short) = 0 OR len(short) = len(long) OR len(list_filter(short, lambda x: NOT list_contains(long, x))) > 0 THEN 0
        WHEN long[len(long) - len(short) + 1:] = short OR (long[1:len(short)] = short AND len(short) > 1) THEN 2 ELSE 1 END AS subset FROM f)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- mentions and text ---------------------------------------------------------------------------------------------------------


@query(f"WITH {MENTIONS} SELECT doc_id, mention FROM mentions")
def mention_extract(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.explode(T.mention_texts(F.col("text"))).alias("mention"))


@query(f"WITH {MENTIONS} SELECT mention, count(*) AS n FROM mentions GROUP BY mention ORDER BY n DESC, mention LIMIT 50")
def mention_topk(spark, sf):
    return mention_extract(spark, sf).groupBy("mention").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "mention").limit(50)


@query()
def mention_spans(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.explode(T.mentions(F.col("text"))).alias("m")).select("doc_id", "m.text", "m.start")


@query(f"WITH {PAIRS} SELECT mention, {NORM('mention')} AS norm, array_to_string({CONTENT(NORM('mention'))}, ' ') AS content, array_to_string(list_transform({CONTENT(NORM('mention'))}, lambda t: left(t, 1)), '') AS initials FROM (SELECT DISTINCT mention FROM name_pairs)")
def normalize_names(spark, sf):
    norm = T.normalize(F.col("mention"))
    return D.name_pairs(spark, sf).select("mention").distinct().select("mention", norm.alias("norm"), F.array_join(T.content_tokens(norm), " ").alias("content"), T.initials(T.content_tokens(norm)).alias("initials"))


@query(rf"SELECT doc_id, sha256(regexp_replace(translate(replace(text, 'ß', 'ss'), '{''.join(vocab.FOLD)}', '{''.join(t * len(s) for s, t in vocab.FOLD.items())}'), '[^\x00-\x7F]', '', 'g')) AS folded FROM documents")
def ascii_fold(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.sha2(T.ascii_fold(F.col("text")), 256).alias("folded"))


@query(f"WITH {MENTIONS}, w AS (SELECT DISTINCT m FROM (SELECT unnest(regexp_extract_all({ASCII_ONLY}, '[A-Z0-9.&]+[a-z]*', 0)) AS m FROM documents)) SELECT m AS word, length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 2 AND strlen(m) <= 7 AND regexp_matches(m, '^[A-Z0-9.&]+$') AS is_acronym FROM w")
def acronym_flags(spark, sf):
    words = F.regexp_extract_all(F.regexp_replace("text", r"[^\x00-\x7F\p{Z}\p{P}\p{S}]", "_"), F.lit("[A-Z0-9.&]+[a-z]*"), F.lit(0))
    return D.table(spark, sf, "documents").select(F.explode(words).alias("word")).distinct().select("word", T.is_acronym(F.col("word")).alias("is_acronym"))


@query()
def name_gate(spark, sf):
    rows = D.name_pairs(spark, sf).select("mention").distinct()
    return rows.select("mention", T.is_generic(F.col("mention")).alias("generic"), T.plausible_name(F.col("mention"), F.lit("other")).alias("plausible"), T.clean_mention(F.concat(F.lit("and the "), "mention", F.lit("'s,"))).alias("cleaned"))


@query(r"""SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 + len(regexp_extract_all(replace(text, chr(10), chr(10) || chr(1) || chr(10)), '[.!?\n][ \t\n\v\f\r]')) END AS INTEGER) AS n FROM documents""")
def sentence_split(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.size(T.split_sentences(F.coalesce("text", F.lit("")))).alias("n"))


@query()
def chunk_text(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.explode(T.chunk_text(F.col("text"))).alias("c")).select("doc_id", "c.start", F.length("c.chunk").alias("n"), F.sha2("c.chunk", 256).alias("chunk_sha256"))


def _html_sql() -> str:
    x = "html"
    for tag in vocab.CONTAINERS:
        x = f"regexp_replace(regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', ' ', 'g'), '(?is)<{tag}.*$', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:[^>]*<)?/*(?:{'|'.join(vocab.BLOCK_TAGS)})(?:[^\p{{L}}\p{{N}}/<>][^<>]*)?>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '<[^>]*$', '', 'g')"
    for entity, char in vocab.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"SELECT page_id, sha256(array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: length(l) >= {vocab.LEAST_BLOCK}), chr(10))) AS text_sha256 FROM pages"


@query(_html_sql())
def html_to_text(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", F.sha2(T.html_to_text(F.col("html")), 256).alias("text_sha256"))


@query(r"SELECT page_id, sha256(trim(regexp_replace(replace(regexp_replace(html, '<[^>]*>?', ' ', 'g'), '>', ''), '\s+', ' ', 'g'))) AS text_sha256 FROM pages")
def strip_tags(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_sha256"))


@query(f"WITH {ITEMS} SELECT content_hash, min(source_ref) AS source_ref, min(license_class) AS least_class FROM items GROUP BY content_hash")
def content_hash_dedup(spark, sf):
    raw = D.items(spark, sf).select("source_type", "source_ref", "title", F.col("raw_text").alias("text"), "license_class", F.lit(None).cast("timestamp").alias("published_at"))
    new = state.ingest(raw, None, F.lit(D.AS_OF).cast("timestamp"))
    return new.select("content_hash", "source_ref", F.col("license_class").alias("least_class"))


@query("""WITH e AS (SELECT event_id, ts, event_id % 4 AS k FROM events)
    SELECT event_id, CASE k WHEN 3 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS at FROM e""")
def feed_dates(spark, sf):
    e = D.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).when(k == 2, F.concat(F.lit("Fri, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", R.parse_feed_date(raw).cast("timestamp_ntz").alias("at"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\[[0-9]+\]')) AS INTEGER) AS citations, len(regexp_extract_all(text, '\[[0-9]+\]')) = 0 AS flagged FROM conversations""")
def citations(spark, sf):
    c = D.table(spark, sf, "conversations")
    flagged = T.flag_uncited(F.col("text"), F.array().cast("array<string>"))
    return c.select("conv_id", "turn", T.citation_count(F.col("text")).alias("citations"), F.startswith(flagged, F.lit(T.WARNING)).alias("flagged"))


def _intent_sql() -> str:
    parts = [f"CASE WHEN {' OR '.join(f'contains(q, {chr(39)}{c}{chr(39)})' for c in cues)} THEN [{QUOTED(types)}] ELSE [] END" for cues, types in vocab.INTENTS]
    return f"WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM conversations), i AS (SELECT conv_id, turn, list_concat({', '.join(parts)}) AS x FROM c) SELECT conv_id, turn, array_to_string(list_sort(list_distinct(x)), ',') AS intents FROM i"


@query(_intent_sql())
def question_intent(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.relation_intents(F.col("text"))), ",").alias("intents"))


@query(r"SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])') AS has_the, CASE WHEN regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') = '' THEN 'related_to' ELSE left(trim(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}]+', '_', 'g'), '_'), 48) END AS relation FROM conversations")
def word_bounded(spark, sf):
    return D.table(spark, sf, "conversations").select("conv_id", "turn", T.contains_word(F.lower("text"), F.lit("the")).alias("has_the"), T.normalize_relation(F.col("text")).alias("relation"))


# ---- blocking and scoring ------------------------------------------------------------------------------------------------------

KEYS = lambda name, id_: f"SELECT DISTINCT {id_} AS id, 'norm' AS key_type, {NORM(name)} AS key FROM names_in WHERE {NORM(name)} <> '' UNION SELECT DISTINCT {id_}, 'token', t FROM (SELECT {id_}, unnest({CONTENT(NORM(name))}) AS t FROM names_in) WHERE strlen(t) >= 3"


@query(f"WITH {PAIRS}, names_in AS (SELECT name FROM names) SELECT id AS entity_id, key_type, key FROM ({KEYS('name', 'name')})")
def block_keys(spark, sf):
    names = D.name_pairs(spark, sf).select(F.col("canonical").alias("name")).distinct().withColumn("entity_id", F.col("name"))
    return blocking.index(names, phonetics=False)


@query()
def block_keys_phonetic(spark, sf):
    names = D.name_pairs(spark, sf).select(F.col("canonical").alias("name")).distinct().withColumn("entity_id", F.col("name"))
    return blocking.index(names)


@query(
    f"""WITH {PAIRS}, mk AS (WITH names_in AS (SELECT mention FROM ways) {KEYS('mention', 'mention')}), ek AS (WITH names_in AS (SELECT name FROM names) {KEYS('name', 'name')}),
    h AS (SELECT mk.id AS mention_id, ek.id AS entity_id, count(*) AS hits FROM mk JOIN ek USING (key_type, key) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY hits DESC, entity_id) AS r FROM h)
    SELECT mention_id, entity_id, hits FROM r WHERE r <= 50"""
)
def block_candidates(spark, sf):
    pairs = D.name_pairs(spark, sf)
    mentions = pairs.select(F.col("mention").alias("name")).distinct().withColumn("mention_id", F.col("name"))
    names = pairs.select(F.col("canonical").alias("name")).distinct().withColumn("entity_id", F.col("name"))
    return blocking.candidates(blocking.index(mentions, "mention_id", False), blocking.index(names, phonetics=False))


@query(f"WITH {FEATURES} SELECT mention, canonical, round(jw, 9) AS jw, round(jaccard, 9) AS jaccard, CAST(subset AS INTEGER) AS subset, CAST(extra AS INTEGER) AS extra FROM g")
def pair_features(spark, sf):
    mt, ct = T.content_tokens(T.normalize(F.col("mention"))), T.content_tokens(T.normalize(F.col("canonical")))
    df = D.name_pairs(spark, sf).withColumns({"mt": mt, "ct": ct})
    jw = S.jaro_winkler_best(T.normalize(F.col("mention")), F.array(T.normalize(F.col("canonical"))))
    a, b = F.col("mt"), F.col("ct")
    return df.select("mention", "canonical", F.round(jw, 9).alias("jw"), F.round(M.jaccard(a, b), 9).alias("jaccard"), M.subset_level(a, b).alias("subset"), M.extra_tokens(a, b).alias("extra"))


def _scored(spark, sf) -> DataFrame:
    pairs = D.name_pairs(spark, sf).select("mention", F.lit("product").alias("mention_type"), "canonical", F.array().cast("array<string>").alias("aliases"), F.when(F.length("canonical") % 2 == 0, "product").otherwise("organization").alias("entity_type"), F.lit(0.0).alias("cooc"), (F.length("mention") % 10).cast("long").alias("corroboration"), (F.length("mention") % 3 == 0).alias("recent"))
    return scoring.score(pairs, phonetics=False)


@query(
    f"""WITH {FEATURES}, e AS (
        SELECT *, m <> c AND replace(m, ' ', '') = replace(c, ' ', '') AND strlen(replace(m, ' ', '')) >= 4 AS compact, CASE WHEN length(canonical) % 2 = 0 THEN 1.0 ELSE -1.5 END AS w_type,
            CASE WHEN jw >= 0.95 THEN 3 WHEN jw >= 0.87 THEN 2 WHEN jw >= 0.75 THEN 1 ELSE 0 END AS lvl,
            length(regexp_replace(mention, '[^A-Za-z]', '', 'g')) >= 2 AND strlen(mention) <= 7 AND regexp_matches(mention, '^[A-Z0-9.&]+$') AS m_acr FROM g
    ), a AS (
        SELECT *, m = c OR compact AS exact, CASE WHEN m = c OR compact OR NOT m_acr THEN 0 WHEN len(ct) >= 2 AND ends_with(array_to_string(list_transform(ct, lambda t: left(t, 1)), ''), replace(m, ' ', '')) THEN 1 ELSE -1 END AS acr,
            greatest(CASE WHEN extra > 0 THEN least(lvl, 2) ELSE lvl END, CASE WHEN subset >= 1 THEN 1 ELSE 0 END) AS idx FROM e
    ), v AS (
        SELECT mention, canonical, w_type + CASE WHEN acr = 1 THEN 6.0 WHEN compact THEN 7.5 ELSE [-3.0, -0.5, 2.5, 4.5][idx + 1] + CASE WHEN exact THEN 3.0 ELSE 0.0 END + CASE WHEN jaccard >= 0.8 THEN 2.0 WHEN jaccard >= 0.5 THEN 1.0 ELSE -1.0 END
            + [0.0, -1.5, -2.5][least(extra, 2) + 1] + [0.0, 1.0, 2.5][subset + 1] + CASE WHEN acr = -1 THEN -3.0 ELSE 0.0 END END AS evidence FROM a
    ), p AS (
        SELECT *, CASE WHEN evidence < 1 THEN 0.0 ELSE CASE WHEN length(mention) % 10 >= 8 THEN 1.0 WHEN length(mention) % 10 >= 3 THEN 0.7 WHEN length(mention) % 10 >= 1 THEN 0.3 ELSE 0.0 END + CASE WHEN length(mention) % 3 = 0 THEN 0.3 ELSE 0.0 END END AS prior FROM v
    )
    SELECT mention, canonical, CAST(round(evidence + least(prior, 2.0), 6) AS DOUBLE) AS total, CASE WHEN evidence + least(prior, 2.0) >= 5 THEN 'merge' WHEN evidence + least(prior, 2.0) < 1 THEN 'new' ELSE 'review' END AS decision FROM p"""
)
def score_pairs(spark, sf):
    return _scored(spark, sf).select("mention", "canonical", F.round("total", 6).alias("total"), "decision")


@query()
def score_pairs_phonetic(spark, sf):
    pairs = D.name_pairs(spark, sf).select("mention", F.lit("product").alias("mention_type"), "canonical", F.array().cast("array<string>").alias("aliases"), F.lit("product").alias("entity_type"), F.lit(0.0).alias("cooc"), F.lit(0).cast("long").alias("corroboration"), F.lit(False).alias("recent"))
    return scoring.score(pairs).select("mention", "canonical", "total", "decision", F.to_json("contributions").alias("contributions"))


@query()
def best_candidate(spark, sf):
    scored = _scored(spark, sf).select(F.col("mention").alias("mention_id"), F.col("canonical").alias("entity_id"), F.lit(1).alias("hits"), "total", "contributions")
    ids = scored.select("entity_id").distinct()
    apart = ids.alias("x").join(ids.alias("y"), F.substring_index("x.entity_id", " ", 1) == F.substring_index("y.entity_id", " ", 1)).where("x.entity_id < y.entity_id").select(F.col("x.entity_id").alias("a_id"), F.col("y.entity_id").alias("b_id")).where(F.abs(F.xxhash64("a_id", "b_id")) % 97 == 0)
    return scoring.best_candidates(scored, apart).select("mention_id", "entity_id", F.round("total", 6).alias("total"), "decision", F.exists("contributions", lambda c: c["name"] == "decorrelation_veto").alias("vetoed"))


# ---- time and graph ------------------------------------------------------------------------------------------------------------


@query(f"WITH {OBSERVATIONS} SELECT from_id, to_id, edge_type, CAST(count(*) AS DOUBLE) AS weight, CAST(count(DISTINCT item_id) AS INTEGER) AS n_sources, min(observed_at) AS valid_at, max(observed_at) AS last_seen FROM observations WHERE from_id <> to_id GROUP BY ALL")
def edge_accumulate(spark, sf):
    return temporal.accumulate(D.observations(spark, sf)).select("from_id", "to_id", "edge_type", "weight", F.size("source_item_ids").alias("n_sources"), "valid_at", "last_seen")


@query(
    f"""WITH {OBSERVATIONS}, e AS (SELECT from_id, to_id, min(observed_at) AS valid_at, min(seq) AS seq FROM observations GROUP BY ALL),
    m AS (SELECT *, max(valid_at) OVER (PARTITION BY from_id ORDER BY seq, to_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e), l AS (SELECT *, top IS NULL OR valid_at >= top AS line FROM m),
    n AS (SELECT *, first(CASE WHEN line THEN valid_at END IGNORE NULLS) OVER (PARTITION BY from_id ORDER BY seq, to_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv, first(CASE WHEN line THEN to_id END IGNORE NULLS) OVER (PARTITION BY from_id ORDER BY seq, to_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt,
        last(CASE WHEN line THEN valid_at END IGNORE NULLS) OVER (PARTITION BY from_id ORDER BY seq, to_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hv, last(CASE WHEN line THEN to_id END IGNORE NULLS) OVER (PARTITION BY from_id ORDER BY seq, to_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ht FROM l)
    SELECT from_id, to_id, valid_at, CASE WHEN line THEN nv ELSE hv END AS invalid_at, CASE WHEN line THEN nt ELSE ht END AS superseded_by FROM n"""
)
def supersession(spark, sf):
    edges = temporal.accumulate(D.observations(spark, sf)).withColumn("edge_id", F.col("to_id"))
    return temporal.supersede(edges).select("from_id", "to_id", "valid_at", "invalid_at", "superseded_by")


@query(f"WITH {EDGES} SELECT edge_id, valid_at, invalid_at, invalid_at IS NULL AS valid_now FROM edges WHERE (valid_at IS NULL OR valid_at <= TIMESTAMP '{D.AS_OF}') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{D.AS_OF}')")
def as_of_edges(spark, sf):
    return temporal.as_of(D.edges(spark, sf), F.expr(f"timestamp_ntz '{D.AS_OF}'")).select("edge_id", "valid_at", "invalid_at", F.col("invalid_at").isNull().alias("valid_now"))


@query(f"WITH {CANDIDATES}, d AS (SELECT DISTINCT item_id, entity_id FROM candidates), l AS (SELECT item_id, entity_id AS a, lead(entity_id) OVER (PARTITION BY item_id ORDER BY entity_id) AS b FROM d) SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL GROUP BY a, b")
def cooc_edges(spark, sf):
    return temporal.adjacent_pairs(D.candidates(spark, sf)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EDGES}, o AS (SELECT unnest(['n0', 'n1', 'n2', 'r0']) AS other), p AS (SELECT 's' || s_suppkey AS entity_id FROM supplier), b AS (SELECT from_id, to_id FROM edges UNION ALL SELECT to_id, from_id FROM edges)
    SELECT p.entity_id AS pair_id, least(count(b.from_id) / 4.0::DOUBLE, 1.0) AS cooc FROM p CROSS JOIN o LEFT JOIN b ON b.from_id = p.entity_id AND b.to_id = o.other GROUP BY p.entity_id"""
)
def cooc_fraction(spark, sf):
    pairs = D.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("pair_id"), F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), T.strings(["n0", "n1", "n2", "r0"]).alias("other_ids"))
    return blocking.cooc_fraction(pairs, D.edges(spark, sf))


@query(f"WITH {CANDIDATES} SELECT entity_id, count(DISTINCT item_id) AS n FROM candidates WHERE status IN ({QUOTED(vocab.SUPPORTED_STATUS)}) GROUP BY entity_id")
def corroboration(spark, sf):
    return blocking.corroboration(D.candidates(spark, sf))


@query(
    f"""WITH {EDGES}, v AS (SELECT * FROM edges WHERE invalid_at IS NULL), b AS (SELECT edge_id, from_id AS a, to_id AS t FROM v UNION ALL SELECT edge_id, to_id, from_id FROM v),
    h0 AS (SELECT * FROM b WHERE a = 's1'), f1 AS (SELECT DISTINCT t FROM h0 WHERE t <> 's1'), h1 AS (SELECT b.* FROM b JOIN f1 ON b.a = f1.t)
    SELECT edge_id, CAST(min(d) AS INTEGER) AS depth FROM (SELECT edge_id, 0 AS d FROM h0 UNION ALL SELECT edge_id, 1 FROM h1) GROUP BY edge_id"""
)
def bfs_2hop(spark, sf):
    return graph.neighbourhood(temporal.valid_now(D.edges(spark, sf)), spark.range(1).select(F.lit("s1").alias("entity_id")))


SLICE_ORDER = "CASE WHEN edge_type IN ('headquartered_in') THEN 0 ELSE 1 END, CASE WHEN edge_type = 'mentioned_with' THEN 1 ELSE 0 END, weight DESC, edge_id"


@query(f"WITH {EDGES}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY {SLICE_ORDER}) AS INTEGER) AS rank FROM edges WHERE invalid_at IS NULL) SELECT rank, edge_id, weight FROM r WHERE rank <= 60")
def slice_top60(spark, sf):
    return graph.ranked_slice(temporal.valid_now(D.edges(spark, sf)).withColumn("depth", F.lit(0)), ["headquartered_in"]).select("rank", "edge_id", "weight")


@query(
    f"""WITH {EDGES}, {ITEMS}, r AS (SELECT *, row_number() OVER (ORDER BY {SLICE_ORDER}) AS rank FROM edges WHERE invalid_at IS NULL), s AS (SELECT rank, generate_subscripts(source_item_ids, 1) AS pos, unnest(source_item_ids) AS item_id FROM r WHERE rank <= 60),
    f AS (SELECT item_id, min(rank * 1000 + pos) AS place FROM s GROUP BY item_id), n AS (SELECT CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS number, item_id FROM f)
    SELECT number, item_id, license_class FROM n JOIN items USING (item_id) WHERE number <= 30"""
)
def cite_numbers(spark, sf):
    ranked = graph.ranked_slice(temporal.valid_now(D.edges(spark, sf)).withColumn("depth", F.lit(0)), ["headquartered_in"])
    return graph.source_numbers(ranked, D.items(spark, sf)).select("number", "item_id", "license_class")


def _hub_sql(types: str) -> str:
    return f"WITH {EDGES}, v AS (SELECT * FROM edges WHERE invalid_at IS NULL {types}) SELECT entity_id, count(*) AS degree FROM (SELECT from_id AS entity_id FROM v UNION ALL SELECT to_id FROM v) GROUP BY entity_id ORDER BY degree DESC, entity_id LIMIT 20"


@query(_hub_sql(""))
def hubs(spark, sf):
    return graph.hubs(D.edges(spark, sf), 20)


@query(_hub_sql("AND edge_type IN ('headquartered_in')"))
def typed_hubs(spark, sf):
    return graph.hubs(D.edges(spark, sf), 20, ["headquartered_in"])


@query(
    f"""WITH {EDGES}, {ITEMS}, u AS (SELECT edge_id, unnest(source_item_ids) AS item_id FROM edges)
    SELECT edge_id, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS sources FROM u JOIN items USING (item_id) WHERE license_class = 'commercial_clean' GROUP BY edge_id"""
)
def license_filter(spark, sf):
    return graph.license_filter(D.edges(spark, sf), D.items(spark, sf), "commercial_clean").select("edge_id", F.array_join("source_item_ids", ",").alias("sources"))


@query(f"WITH {EDGES} SELECT edge_id, valid_at FROM edges WHERE (from_id = 'n3' OR to_id = 'n3') AND edge_type <> 'mentioned_with'")
def timeline(spark, sf):
    return graph.timeline(D.edges(spark, sf), "n3").select("edge_id", "valid_at")


@query(f"WITH {EDGES} SELECT edge_id, weight FROM edges WHERE (from_id = 'n3' OR to_id = 'n3') AND invalid_at IS NULL ORDER BY edge_type = 'mentioned_with', weight DESC, edge_id LIMIT 200")
def entity_detail_edges(spark, sf):
    e = temporal.valid_now(D.edges(spark, sf)).where("from_id = 'n3' OR to_id = 'n3'")
    return e.orderBy(F.col("edge_type") == "mentioned_with", F.col("weight").desc(), "edge_id").limit(200).select("edge_id", "weight")


@query(f"WITH {EDGES} SELECT edge_id, edge_type, weight FROM edges WHERE edge_type IN ({QUOTED(vocab.ESCALATE_TYPES)}) OR weight >= 2.0")
def escalations(spark, sf):
    return evaluate.escalations(D.edges(spark, sf)).select("edge_id", "edge_type", "weight")


# ---- listings and counts -------------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT source_type, license_class, count(*) AS n FROM items GROUP BY ALL")
def source_counts(spark, sf):
    return D.items(spark, sf).groupBy("source_type", "license_class").agg(F.count("*").alias("n"))


@query(f"WITH {ITEMS} SELECT license_class, count(*) AS n FROM items GROUP BY license_class")
def license_counts(spark, sf):
    return D.items(spark, sf).groupBy("license_class").agg(F.count("*").alias("n"))


@query(f"WITH {CANDIDATES} SELECT status, count(*) AS n FROM candidates GROUP BY status")
def status_counts(spark, sf):
    return D.candidates(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES} SELECT entity_type, count(*) AS n FROM entities WHERE is_live GROUP BY entity_type")
def type_counts(spark, sf):
    return D.entities(spark, sf).where("is_live").groupBy("entity_type").agg(F.count("*").alias("n"))


@query(f"WITH {ENTITIES}, {EDGES}, {ITEMS} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM entities WHERE is_live) AS live, (SELECT count(*) FROM edges WHERE invalid_at IS NULL) AS valid_edges, (SELECT count(*) FROM items) AS items")
def status_summary(spark, sf):
    e = D.entities(spark, sf).agg(F.count("*").alias("entities"), F.count_if("is_live").alias("live"))
    return e.join(D.edges(spark, sf).agg(F.count_if(F.col("invalid_at").isNull()).alias("valid_edges"))).join(D.items(spark, sf).agg(F.count("*").alias("items")))


@query(f"WITH {ENTITIES} SELECT entity_id, last_seen FROM entities WHERE is_live AND entity_type = 'person' ORDER BY last_seen DESC, entity_id LIMIT 50")
def entity_listing(spark, sf):
    return D.entities(spark, sf).where("is_live AND entity_type = 'person'").orderBy(F.col("last_seen").desc(), "entity_id").limit(50).select("entity_id", "last_seen")


@query(f"WITH {CANDIDATES}, names AS (SELECT DISTINCT mention AS entity_id FROM mentions WHERE length(mention) % 2 = 0) SELECT candidate_id, match_score, n.entity_id AS found FROM candidates c LEFT JOIN names n USING (entity_id) WHERE status = 'pending_review' ORDER BY match_score DESC NULLS LAST, candidate_id LIMIT 200")
def review_queue(spark, sf):
    c = D.candidates(spark, sf)
    names = c.select("entity_id").distinct().where(F.length("entity_id") % 2 == 0).withColumn("found", F.col("entity_id"))
    return c.where("status = 'pending_review'").join(names, "entity_id", "left").orderBy(F.col("match_score").desc_nulls_last(), "candidate_id").limit(200).select("candidate_id", "match_score", "found")


@query(f"WITH {CANDIDATES}, {ITEMS} SELECT candidate_id, source_ref, license_class, published_at, CASE WHEN c.status IN ('resolved') THEN 'tier 2' ELSE 'tier 1' END AS tier FROM candidates c JOIN items i USING (item_id)")
def why_mentions(spark, sf):
    c = D.candidates(spark, sf)
    return c.join(D.items(spark, sf).drop("status"), "item_id").select("candidate_id", "source_ref", "license_class", "published_at", F.when(F.col("status") == "resolved", "tier 2").otherwise("tier 1").alias("tier"))


@query("WITH c AS (SELECT max(ts) AS cursor FROM events WHERE ts < TIMESTAMP '2024-01-15'), n AS (SELECT event_id, ts FROM events, c WHERE ts > cursor ORDER BY ts, event_id LIMIT 200) SELECT event_id, ts FROM n")
def checkpoint_incremental(spark, sf):
    from kinweave.sources import readers

    e = D.table(spark, sf, "events")
    return readers.newer_than(e, "ts", e.where("ts < timestamp_ntz '2024-01-15'").agg(F.max("ts").alias("cursor")), 200, "event_id").select("event_id", "ts")


@query(f"WITH {ENTITIES}, names_in AS (SELECT entity_id AS name_id, canonical_name AS name FROM entities), k AS ({KEYS('name', 'name_id')}), q AS (WITH names_in AS (SELECT 'Almond Antique Blue' AS name, 'q' AS q) {KEYS('name', 'q')}) SELECT k.id AS entity_id, count(*) AS hits FROM k JOIN q USING (key_type, key) GROUP BY k.id ORDER BY hits DESC, entity_id LIMIT 50")
def entity_search(spark, sf):
    return listing.search_entities(D.entities(spark, sf), "Almond Antique Blue", phonetics=False)


@query(f"WITH {EDGES} SELECT edge_id, weight FROM edges WHERE invalid_at IS NULL AND edge_type <> 'mentioned_with' ORDER BY weight DESC, edge_id LIMIT 200")
def typed_edges_top(spark, sf):
    return listing.typed_edges(D.edges(spark, sf)).select("edge_id", "weight")


def _mentioned(spark, sf) -> DataFrame:
    return D.candidates(spark, sf).select("entity_id").distinct().select("entity_id", F.col("entity_id").alias("canonical_name"), F.lit("other").alias("entity_type"))


@query(f"WITH {CANDIDATES} SELECT entity_id, entity_id AS canonical_name, 'other' AS entity_type, count(DISTINCT item_id) AS n FROM candidates WHERE status IN ('auto_merged', 'resolved', 'confirmed') GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 25")
def top_corroborated(spark, sf):
    return listing.top_corroborated(_mentioned(spark, sf), D.candidates(spark, sf))


@query(f"WITH {ENTITIES}, geo AS (SELECT 'location:' || n_name AS entity_id FROM nation WHERE n_regionkey < 2) SELECT entity_id FROM entities WHERE entity_type = 'location' AND is_live AND entity_id NOT IN (SELECT entity_id FROM geo)")
def ungeocoded(spark, sf):
    geo = D.table(spark, sf, "nation").where("n_regionkey < 2").select(F.concat(F.lit("location:"), "n_name").alias("entity_id"))
    return listing.ungeocoded(D.entities(spark, sf), geo).select("entity_id")


@query(f"WITH {CANDIDATES}, {ITEMS}, r AS (SELECT source_ref, mention_text, c.status, row_number() OVER (PARTITION BY source_ref, mention_text ORDER BY published_at DESC, candidate_id DESC) AS r FROM candidates c JOIN items USING (item_id)) SELECT source_ref, mention_text, status FROM r WHERE r = 1")
def candidate_state(spark, sf):
    i = D.items(spark, sf)
    c = D.candidates(spark, sf).join(i.select("item_id", F.col("published_at").alias("observed_at")), "item_id")
    return listing.latest_states(c, i).select("source_ref", "mention_text", "status")


@query(f"WITH {CANDIDATES} SELECT DISTINCT item_id FROM candidates WHERE status = 'needs_llm' ORDER BY item_id LIMIT 100")
def waiting_items(spark, sf):
    return enrich.waiting(D.candidates(spark, sf), 100)


@query("SELECT conv_id AS item_id, mention_text, start, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(mention_text) ORDER BY score DESC, start) AS r FROM (SELECT conv_id, role AS mention_text, CAST(turn AS INTEGER) AS start, length(text) % 10 / 10.0::DOUBLE AS score FROM conversations)) WHERE r = 1")
def strongest_mentions(spark, sf):
    m = D.table(spark, sf, "conversations").select(F.col("conv_id").alias("item_id"), F.col("role").alias("mention_text"), F.col("turn").cast("int").alias("start"), (F.length("text") % 10 / 10.0).alias("score"))
    return listing.strongest_mentions(m)


@query()
def score_breakdown(spark, sf):
    return _scored(spark, sf).select("mention", "canonical", listing.breakdown(F.col("contributions")).alias("breakdown"))


@query()
def graph_export(spark, sf):
    return listing.graph_rows(D.entities(spark, sf), D.edges(spark, sf))


@query()
def sane_canonical(spark, sf):
    pairs = D.name_pairs(spark, sf).select("mention", F.col("canonical").alias("canonical_name"), F.lit("product").alias("entity_type"))
    return enrich.sane_canonical(pairs).select("mention", "canonical_name", "canonical")


# ---- questions and resolution --------------------------------------------------------------------------------------------------


@query()
def ask_slice(spark, sf):
    names = D.entities(spark, sf).where("entity_type = 'location'").withColumn("entity_id", F.concat(F.lit("n"), F.element_at(F.split("entity_id", ":"), -1)))
    n = D.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_name").alias("entity_id"), F.concat(F.lit("n"), "n_nationkey").alias("node"))
    entities = names.join(n, "entity_id").drop("entity_id").withColumnRenamed("node", "entity_id")
    return answer.ask("Which companies are headquartered in France or Germany?", entities, D.edges(spark, sf), D.items(spark, sf))["edges"].select("rank", "edge_id", "weight")


@query(f"WITH {EDGES} SELECT edge_id, valid_at FROM edges WHERE (from_id = 'n3' OR to_id = 'n3') AND invalid_at IS NULL AND edge_type <> 'mentioned_with'")
def dossier_timeline(spark, sf):
    e = D.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("canonical_name"))
    return answer.dossier("n3", e, D.edges(spark, sf), D.items(spark, sf))["timeline"].select("edge_id", "valid_at")


@query(f"WITH {ENTITIES}, {CANDIDATES} SELECT (SELECT count(*) FROM entities WHERE last_seen >= TIMESTAMP '2024-01-20') AS new_entities, (SELECT count(*) FROM candidates WHERE status = 'pending_review') AS pending_review")
def digest_counts(spark, sf):
    return answer.digest(D.entities(spark, sf), D.edges(spark, sf), D.candidates(spark, sf), F.expr("timestamp_ntz '2024-01-20 00:00:00'"))["counts"]


@query()
def resolve_batch(spark, sf):
    i = D.items(spark, sf).withColumn("observed_at", F.col("published_at"))
    return resolve.resolve(resolve.extract(i), D.entities(spark, sf), F.expr(f"timestamp_ntz '{D.AS_OF}'"), edges=D.edges(spark, sf))["candidates"].select("item_id", "mention_text", "status", F.round("match_score", 6).alias("match_score"))


# ---- changes of state ----------------------------------------------------------------------------------------------------------


@query(f"WITH {ENTITIES} SELECT entity_id, is_live AND NOT expiry_time < TIMESTAMP '{D.AS_OF}' AS is_live FROM entities")
def expire(spark, sf):
    return state.expire(D.entities(spark, sf), F.expr(f"timestamp_ntz '{D.AS_OF}'")).select("entity_id", "is_live")


@query(f"WITH {ENTITIES} SELECT entity_id, is_live OR entity_type = 'person' AS is_live, CASE WHEN entity_type = 'person' THEN TIMESTAMP '{D.AS_OF}' ELSE last_seen END AS last_seen FROM entities")
def touch_revive(spark, sf):
    e = D.entities(spark, sf)
    return state.touch(e, e.where("entity_type = 'person'").select("entity_id"), F.expr(f"timestamp_ntz '{D.AS_OF}'")).select("entity_id", "is_live", "last_seen")


@query(f"WITH p AS (SELECT least(user_id, event_id % 50) AS a, greatest(user_id, event_id % 50) AS b, event_type AS reason, ts FROM events WHERE user_id <> event_id % 50), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC, reason DESC) AS r FROM p) SELECT a AS a_id, b AS b_id, reason, ts AS decided_at FROM r WHERE r = 1")
def decorrelate_upsert(spark, sf):
    e = D.table(spark, sf, "events")
    return state.decorrelate(None, e.select(F.col("user_id").alias("a_id"), (F.col("event_id") % 50).alias("b_id"), F.col("event_type").alias("reason"), F.col("ts").alias("decided_at")))


@query(
    f"""WITH {EDGES}, m AS (SELECT 's' || s_suppkey AS absorb_id, 's' || (s_suppkey - 1) AS keep_id FROM supplier WHERE s_suppkey % 10 = 2 AND s_suppkey % 4 <> 0)
    SELECT coalesce(m.keep_id, from_id) AS from_id, to_id, count(*) AS n FROM edges LEFT JOIN m ON m.absorb_id = from_id GROUP BY ALL"""
)
def merge_entities(spark, sf):
    s = D.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit(0.5).alias("confidence"), F.col("s_suppkey").alias("k"))
    merges = s.where("k % 10 = 2").select(F.col("entity_id").alias("absorb_id"), F.concat(F.lit("s"), F.col("k") - 1).alias("keep_id"), "k")
    apart = state.decorrelate(None, merges.where("k % 4 = 0").select(F.col("absorb_id").alias("a_id"), F.col("keep_id").alias("b_id"), F.lit("human").alias("reason"), F.lit(D.AS_OF).cast("timestamp").alias("decided_at")))
    none = spark.createDataFrame([], "candidate_id string, entity_id string")
    _, edges, _, _ = state.merge_entities(s.drop("k"), D.edges(spark, sf), none, apart, merges)
    return edges.groupBy("from_id", "to_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {CANDIDATES}, d AS (SELECT candidate_id, ['confirm', 'reject', 'new'][CAST(length(mention_text) % 3 AS INTEGER) + 1] AS decision FROM candidates WHERE status = 'pending_review')
    SELECT candidate_id, CASE decision WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' WHEN 'new' THEN 'new' ELSE status END AS status, CASE WHEN decision IN ('reject', 'new') THEN sha256('decision|' || candidate_id) ELSE entity_id END AS entity_id FROM candidates LEFT JOIN d USING (candidate_id)"""
)
def apply_decisions(spark, sf):
    c = D.candidates(spark, sf).withColumn("mention_type", F.lit(None).cast("string"))
    decision = F.element_at(T.strings(["confirm", "reject", "new"]), (F.length("mention_text") % 3 + 1).cast("int"))
    decisions = c.where("status = 'pending_review'").select("candidate_id", decision.alias("decision"), F.lit("tester").alias("actor"), F.lit(None).cast("string").alias("reason"))
    return state.apply_decisions(c, decisions, F.lit(D.AS_OF).cast("timestamp"))["candidates"].select("candidate_id", "status", "entity_id")


@query()
def prune_entities(spark, sf):
    names = D.candidates(spark, sf).select("mention_text").distinct().select(F.col("mention_text").alias("entity_id"), F.lit("person").alias("entity_type"), F.col("mention_text").alias("canonical_name"))
    return state.prune(D.entities(spark, sf).select("entity_id", "entity_type", "canonical_name").unionByName(names)).select("entity_id", "canonical_name")


@query()
def audit_relations(spark, sf):
    items = D.items(spark, sf)
    c = D.candidates(spark, sf)
    pairs = temporal.adjacent_pairs(c).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("partner_of").alias("edge_type"), "item_id").groupBy("from_id", "to_id", "edge_type").agg(F.collect_set("item_id").alias("source_item_ids"))
    entities = c.select("entity_id").distinct().select("entity_id", F.col("entity_id").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit("other").alias("entity_type"))
    return evaluate.audit_relations(pairs.withColumn("edge_id", F.concat_ws("|", "from_id", "to_id")), entities, items)


@query("SELECT CAST(user_id AS VARCHAR) AS token_id, CAST(ts AS DATE) AS day, count(*) AS asks, greatest(2 - count(*), 0) AS remaining, count(*) < 2 AS allowed FROM events GROUP BY ALL")
def quota(spark, sf):
    e = D.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("token_id"), F.col("ts").alias("at"))
    return state.quota(e, e.select("token_id").distinct().withColumn("ask_daily_limit", F.lit(2).cast("long")))


# ---- evaluation and places -----------------------------------------------------------------------------------------------------

SCORED = "scored AS (SELECT least(n_chars / 500.0::DOUBLE, 15.0) AS total, quality = 1 AS is_match FROM documents JOIN labels USING (doc_id))"
SWEEP = f"""{SCORED}, t AS (SELECT unnest(range(0, 25)) * 0.5::DOUBLE AS threshold), c AS (
    SELECT threshold, count(*) FILTER (WHERE total >= threshold AND is_match) AS tp, count(*) FILTER (WHERE total >= threshold AND NOT is_match) AS fp, count(*) FILTER (WHERE total < threshold AND is_match) AS fn, count(*) FILTER (WHERE total < threshold AND NOT is_match) AS tn FROM t, scored GROUP BY threshold
), p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS rc FROM c), f AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM p)"""


def _labelled(spark, sf) -> DataFrame:
    return D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id").select(F.least(F.col("n_chars") / 500.0, F.lit(15.0)).alias("total"), (F.col("quality") == 1).alias("is_match"))


@query(f"WITH {SWEEP} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1 FROM f")
def threshold_sweep(spark, sf):
    return evaluate.sweep(_labelled(spark, sf)).select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SWEEP} SELECT (SELECT threshold FROM f ORDER BY f1 DESC, threshold DESC LIMIT 1) AS best, (SELECT threshold FROM f WHERE pr >= 0.85 ORDER BY f1 DESC, threshold DESC LIMIT 1) AS best_precise")
def best_threshold(spark, sf):
    return evaluate.best_thresholds(evaluate.sweep(_labelled(spark, sf)))


@query(f"WITH {SCORED} SELECT count(*) FILTER (WHERE total >= 5 AND is_match) AS tp, count(*) FILTER (WHERE total >= 5 AND NOT is_match) AS fp, count(*) FILTER (WHERE total < 5 AND is_match) AS fn, count(*) FILTER (WHERE total < 5 AND NOT is_match) AS tn FROM scored")
def confusion(spark, sf):
    return _labelled(spark, sf).agg(*evaluate.confusion(F.col("total") >= 5, F.col("is_match")))


@query(f"WITH {SCORED} SELECT avg(CASE WHEN total >= 5 OR total < 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS review_rate FROM scored")
def review_rate(spark, sf):
    return _labelled(spark, sf).agg(evaluate.review_rate(F.when(F.col("total") >= 5, "merge").when(F.col("total") < 1, "new").otherwise("review")))


@query(
    """WITH places AS (SELECT n_nationkey AS geonameid, n_name AS name, n_nationkey * 1.5::DOUBLE AS lat, n_nationkey * 2.5::DOUBLE AS lon, n_regionkey AS region, count(c_custkey) AS population FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT 'e' || c_custkey AS entity_id, geonameid, lat, lon, name AS place_name, CAST(round(CASE WHEN c_custkey % 2 = 0 THEN 0.8 ELSE 0.8 * 0.8 END, 6) AS DOUBLE) AS confidence FROM customer JOIN places ON geonameid = c_nationkey"""
)
def geocode(spark, sf):
    n, c = D.table(spark, sf, "nation"), D.table(spark, sf, "customer")
    population = c.groupBy("c_nationkey").agg(F.count("*").alias("population"))
    places = n.join(population, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("geonameid"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("lat"), (F.col("n_nationkey") * 2.5).alias("lon"), F.lit("XX").alias("country"), F.lit("PPL").alias("feature_code"), F.coalesce("population", F.lit(0)).alias("population"))
    names = places.select(T.normalize(F.col("name")).alias("name_norm"), "geonameid")
    countries = spark.createDataFrame([], "iso string, name_norm string, name string, capital string")
    asked = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("e"), "c_custkey").alias("entity_id"), F.lit("location").alias("entity_type"), F.when(F.col("c_custkey") % 2 == 0, F.initcap("n_name")).otherwise(F.concat(F.initcap("n_name"), F.lit(", somewhere"))).alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("is_live"))
    return evaluate.geocode(asked, places, names, countries)


@query("""WITH g AS (SELECT event_id, value, (epoch_ms(ts) / 86400000.0::DOUBLE + 2440587.5 - 2451545.0) / 36525.0 AS t FROM events), s AS (SELECT event_id, value, 67310.54841 + (876600.0 * 3600.0 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t AS s FROM g),
    r AS (SELECT event_id, value, radians((s - floor(s / 86400.0) * 86400.0) / 240.0) AS gmst FROM s)
    SELECT event_id, CAST(round(gmst, 2) AS DOUBLE) AS gmst, CAST(round(degrees(asin(1000.0 / sqrt(7000.0 * 7000.0 + value * value + 1000.0 * 1000.0))), 5) AS DOUBLE) AS lat FROM r""")
def sidereal(spark, sf):
    e = D.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    geo = R.teme_to_geo(F.lit(7000.0), F.col("value"), F.lit(1000.0), F.col("at"))
    return e.select("event_id", F.round(R.gmst_radians(F.col("at")), 2).alias("gmst"), F.round(geo["lat"], 5).alias("lat"))
