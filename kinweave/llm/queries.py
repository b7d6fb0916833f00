"""The queries of this subpackage and their SQL: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowfile, chunked_bpe, classify, common, packing, quality, simhash, suffix, tokens, topk, warc


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op6_arrow_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "tokens")
    return arrowfile.read_documents(arrowfile.write_tokens(common.table(spark, sf_dir, "documents"), folder, tokens.tokenizer_path("byte_bpe_50k.json")))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(common.table(spark, sf_dir, "pages"), common.new_folder(spark, "warc")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(common.table(spark, sf_dir, "documents"))


def op10_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encoded(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_near_dedup, op3_exact_topk, op4_quality_classifier, op5_toxicity, op6_arrow_token_file, op7_warc_zstd, op8_quality_rules, op9_suffix_array_dedup, op10_chunked_bpe)}
ORACLES: dict[str, str] = {
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_quality_rules": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        s AS (
            SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
        ),
        i AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3),
        g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM i),
        r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
        m AS (
            SELECT s.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
            FROM s LEFT JOIN r ON r.rid = s.rid
        ),
        b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * word_chars // greatest(n_words, 1) AS word_length,
                1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS duplicate_lines, 1000 * n_repeat_words // greatest(n_words, 1) AS repetition FROM m
        ),
        u AS (
            SELECT lang, source, unnest(['word_length', 'symbols', 'duplicate_lines', 'repetition']) AS rule, unnest([word_length, symbols, duplicate_lines, repetition]) AS v FROM b WHERE NOT base_failed
        ),
        k AS (
            SELECT lang, source, rule, count(*) AS n, CASE WHEN v < 1024 THEN v WHEN v < 8192 THEN v - v % 16 WHEN v < 65536 THEN v - v % 128 WHEN v < 524288 THEN v - v % 1024 WHEN v < 4194304 THEN v - v % 8192
                WHEN v < 33554432 THEN v - v % 65536 WHEN v < 268435456 THEN v - v % 524288 WHEN v < 2147483648 THEN v - v % 4194304 ELSE v - v % 33554432 END AS bin
            FROM u GROUP BY lang, source, rule, bin
        ),
        l AS (
            SELECT 2 AS level, lang, source, rule, bin, n FROM k UNION ALL SELECT 1, lang, '', rule, bin, sum(n) FROM k GROUP BY lang, rule, bin UNION ALL SELECT 0, '', '', rule, bin, sum(n) FROM k GROUP BY rule, bin
        ),
        c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bin) AS below, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM l),
        q AS (
            SELECT level, lang, source, rule, max(total) AS n, min(bin) FILTER (WHERE 4 * below >= total) AS q1, min(bin) FILTER (WHERE 2 * below >= total) AS q2, min(bin) FILTER (WHERE 4 * below >= 3 * total) AS q3
            FROM c GROUP BY level, lang, source, rule
        ),
        h AS (
            SELECT o.lang, o.source, o.rule, CASE WHEN o.n >= 100 THEN o.q2 WHEN a.n >= 100 THEN a.q2 ELSE z.q2 END AS mid,
                greatest(4 * CASE WHEN o.n >= 100 THEN o.q3 - o.q1 WHEN a.n >= 100 THEN a.q3 - a.q1 ELSE z.q3 - z.q1 END,
                    CASE o.rule WHEN 'word_length' THEN 100 WHEN 'symbols' THEN 100 WHEN 'duplicate_lines' THEN 340 ELSE 200 END) AS reach
            FROM q o JOIN q a ON a.level = 1 AND a.lang = o.lang AND a.rule = o.rule JOIN q z ON z.level = 0 AND z.rule = o.rule WHERE o.level = 2
        ),
        x AS (
            SELECT lang, source, max(mid + reach) FILTER (WHERE rule = 'word_length') AS wh, max(mid - reach) FILTER (WHERE rule = 'word_length') AS wl, max(mid + reach) FILTER (WHERE rule = 'symbols') AS sh,
                max(mid + reach) FILTER (WHERE rule = 'duplicate_lines') AS dh, max(mid + reach) FILTER (WHERE rule = 'repetition') AS rh FROM h GROUP BY lang, source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND coalesce(word_length <= wh, true) AND coalesce(word_length >= wl, true) AND coalesce(symbols <= sh, true) AND coalesce(duplicate_lines <= dh, true) AND coalesce(repetition <= rh, true) AS kept
        FROM b LEFT JOIN x ON x.lang = b.lang AND x.source = b.source""",
    "op7_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m""",
}
