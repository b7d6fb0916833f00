from collections import Counter

import pytest

pytest.importorskip("kinweave.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from kinweave.llm import classify, common, quality  # noqa: E402

DATA = "/root/testdata/sf0.001"


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(rows):
    """doc_ids that stay: the smallest of each group of texts with a Jaccard similarity of 0.8 or more, over all pairs."""
    ids, sets = list(rows), [shingles(t) for t in rows.values()]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


def trimmed(rows, width):
    """Texts without the bytes of every string of `width` bytes that starts twice, by counting all of them."""
    raws = {d: t.encode() for d, t in rows.items()}
    seen = Counter(r[k : k + width] for r in raws.values() for k in range(len(r) - width + 1))
    out = {}
    for d, r in raws.items():
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        out[d] = bytes(b for b, g in zip(r, gone, strict=True) if not g).decode(errors="ignore")
    return out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = {
        "quality_rules": lambda df: {r.doc_id: r.text for r in df.join(quality.judge(df).where("kept").select("doc_id"), "doc_id").collect()},
        "toxicity": lambda df: {r.doc_id: r.text for r in df.join(classify.toxicity(df, common.table(spark, DATA, "labels")).where("predicted = 0").select("doc_id"), "doc_id").collect()},
        "simhash_near_dedup": lambda df: (lambda t: {d: t[d] for d in one_of_each(t)})({r.doc_id: r.text for r in df.collect()}),
        "suffix_array_dedup": lambda df: trimmed({r.doc_id: r.text for r in df.collect()}, pipeline.PASSAGE_BYTES),
    }
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        wanted = expected[name](kept)
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == wanted and len(rows) == len(wanted), name
        kept = spark.createDataFrame(rows, docs.schema)
    assert 0.5 < kept.count() / docs.count() < 1
    packed = pipeline.run(spark, DATA)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_passages_of_over_fifty_words_go(spark):
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    passage = words(7, 51)
    rows = [(1, f"{words(1, 120)} {passage} {words(2, 90)}"), (2, f"{passage} {words(3, 200)}"), (3, words(4, 150))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = {r.doc_id: r.text for r in dict(pipeline.STAGES)["suffix_array_dedup"](spark, docs, DATA).collect()}
    assert passage not in out[1] and passage not in out[2] and words(3, 200)[1:] in out[2] and out[3] == rows[2][1]


def test_a_table_without_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
