"""A corpus made ready for training: quality rules, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import classify, common, packing, quality, simhash, suffix, tokens


_results: list[str] = []


def _begin(spark: SparkSession) -> None:
    """Before a stage: the stage before has been written, so what it had stashed can go."""
    common.bound_batches(spark)
    common.release(spark, _results)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the adaptive thresholds reject go."""
    _begin(spark)
    return quality.keep(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; labels come from the table, texts from docs."""
    _begin(spark)
    return classify.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: five-word shingles, similarity 0.8 or more."""
    _begin(spark)
    return simhash.keep_one(docs)


#: Bytes from which a repeated passage goes: less than passages of over 50 words take (of windows of 51 words in the test documents 99.9 %
#: take 249 bytes or more), so that those are all found.
PASSAGE_BYTES = 200


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats over PASSAGE_BYTES or more goes from the texts; documents stay, even if nothing is left of their texts."""
    _begin(spark)
    return suffix.trim(docs, PASSAGE_BYTES)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed in sequences of at most 4096: as op1's query returns them."""
    _begin(spark)
    return packing.pack_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express most stages; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), name)
        _results[:] = common.STASHED[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
