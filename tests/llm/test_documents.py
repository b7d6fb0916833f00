"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("kinweave.llm")

from kinweave.llm import anchors, arrowfile, chunked_bpe, classify, common, graph, packing, quality, simhash, suffix, tokens  # noqa: E402

WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, piece string, sequence_id string, fp string, cell string, group string, `start` string, n string, score string"


def sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "Eta,", "theta.", "iota's", "kappa!!", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 220)) for _ in range(40)]
    passage = sentence(rng, 90)
    texts += [texts[3], texts[3], texts[4] + " more", passage + " " + sentence(rng, 60), sentence(rng, 50) + "\n" + passage, passage, sentence(rng, 9000), "", None, "  \t\n ", "one", "日本語テキスト" * 60, "a  b\r\n<|endoftext|> c <|startoftext|>", "\n".join(["same line here"] * 40), "é" * 700]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id " + passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.bound_batches(spark)
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, "s", "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def test_encoder_equals_the_library(rows):
    texts = [t or "" for _, t in rows] + [" lead", "trail ", "a\n\nb", "x y", "İΣς", "q <| r", "tab\there", "nul\x00 \x01 x", "don't we'll 12 3a"]
    for path in (WORD, BYTE):
        for _ in range(2):  # once with all units new, once with all known
            assert [a.tolist() for a in tokens.encoder(path).batch(texts)] == [tokens.load(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_when_its_memory_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_UNITS", 3)
    enc, texts = tokens.Encoder(BYTE), ["some words, here! and", "some more words, here!"]
    assert [a.tolist() for a in enc.batch(texts)] == [tokens.load(BYTE).encode(t, add_special_tokens=False).ids for t in texts] and len(enc.later) <= 3


def test_packing(docs, rows, none):
    got = packing.pack_documents(docs, WORD, most=256).toPandas()
    expected = Counter()
    for i, t in rows:
        ids = np.array([*tokens.load(WORD).encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            expected[i, k, at, len(ids[at : at + 256]), zlib.crc32(ids[at : at + 256].tobytes())] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == expected
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) * 1.05 + 2
    assert packing.pack_documents(none, WORD).count() == 0


def test_local_search_empties_a_bin():
    lengths = np.array([6, 5, 4, 4, 1])
    bins = packing.local_search(lengths, [[0], [1], [2, 3], [4]], 10)
    assert len(bins) == 2 and sorted(i for b in bins for i in b) == list(range(5)) and all(lengths[b].sum() <= 10 for b in bins)


def brute_fingerprint(t, words=3):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    v = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("per_row", [simhash.PAIRS_PER_ROW, 0, 1])
def test_simhash(docs, rows, none, per_row):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    expected = sorted(((d, fps[i], low.get(find(i))) for i, (d, _) in enumerate(rows)), key=key)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs, per_row=per_row).collect()), key=key) == expected
    assert simhash.near_duplicates(none).count() == 0


def test_grid_finds_all_close_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in base for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    near = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    seen = set()

    def links(pairs):
        seen.update((r.a, r.b) for r in simhash.within(pairs, 3).collect())
        return simhash.within(pairs, 3).limit(0)  # no link is kept, so every pair must be offered

    graph_linked = graph.linked
    for per_row in (simhash.PAIRS_PER_ROW, 0):
        seen.clear()
        monkeypatch.setattr(graph, "linked", lambda members, _, __: graph_linked(members, links, per_row))  # noqa: B023
        simhash.linked(df, 3)
        assert {(max(p), min(p)) for p in seen} == near


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(1000, 1300)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    root = {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert set(got) == set(root) and len(set(got.values())) == len(set(root.values())) == len({(got[n], root[n]) for n in root})
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t):
    w = t.encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_one_of_each_group_of_similar_texts_stays(spark):
    rng = random.Random(9)
    texts = [sentence(rng, 150) for _ in range(12)]
    for k in range(8):
        w = texts[k].split(" ")
        w[20 + k] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[1]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, texts[2], "k"), (None, None, "k")], "doc_id long, text string, id string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns and {(r.doc_id, r.text) for r in out.where("doc_id < 12").collect()} == set(enumerate(texts[:12]))
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == list(range(12)) and out.where("doc_id is null").count() == 1
    assert simhash.keep_one(df.limit(0)).count() == 0


def linked(texts, similarity=0.8):
    """Index pairs of texts whose five-word shingles have that Jaccard similarity, by brute force."""
    sets = [shingles(t) for t in texts]
    return {(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def in_one_group(spark, texts):
    """A function that tells whether two of the texts, by index, are in one group of similar()."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.node: r.root for r in simhash.similar(df).collect()}
    ids = [r.id for r in df.selectExpr("doc_id", "xxhash64(text) as id").orderBy("doc_id").collect()]
    return lambda i, j: root.get(ids[i], ids[i]) == root.get(ids[j], ids[j])


@pytest.mark.parametrize("n", [12, 60])
def test_no_pair_is_dropped_among_many_texts_of_the_same_words(spark, n, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS_PER_ROW", 1)
    rng = random.Random(n)
    words = sentence(rng, 150).split(" ")
    texts = [" ".join(rng.sample(words, len(words))) for _ in range(n)]
    texts += [t + " end" for t in texts] + [f"{texts[0]} end of {k}" for k in range(20)]
    true, same = linked(texts), in_one_group(spark, texts)
    assert len(true) >= n + 190 and all(same(i, j) for i, j in true)
    assert not any(same(i, j) for j in range(n) for i in range(j))


def test_texts_with_appended_or_replaced_passages_are_found(spark):
    rng = random.Random(3)
    texts, pairs = [], []
    for n in (80, 200):
        for k in range(60):
            w = sentence(rng, n).split(" ")
            more = sentence(rng, n // 7 if k % 2 else n // 13).split(" ")
            texts += [" ".join(w), " ".join(w + more if k % 4 < 2 else w[: n // 2] + more[: n // 13] + w[n // 2 + n // 13 :])]
            pairs.append((len(texts) - 2, len(texts) - 1))
    sets = [shingles(t) for t in texts]
    close = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    same = in_one_group(spark, texts)
    assert len(close) >= 80 and all(same(i, j) for i, j in close)
    assert not any(same(i, j) for i, j in set(pairs) - set(close))
    assert (1 - 0.8**simhash.ROWS) ** simhash.BANDS < 2e-5


def test_token_files(docs, rows, none, spark):
    got = sorted((tuple(r) for r in arrowfile.read_documents(arrowfile.write_tokens(docs, common.new_folder(spark, "t"), BYTE)).collect()), key=lambda r: r[1])
    at, expected = 0, []
    for i, t in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, (r[1] or "").encode()))):
        ids = np.array([*tokens.load(BYTE).encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == expected
    assert arrowfile.read_documents(arrowfile.write_tokens(none, common.new_folder(spark, "t"), BYTE)).count() == 0


def test_random_access(tmp_path):
    w = arrowfile.TokenWriter(f"{tmp_path}/t.arrow", f"{tmp_path}/d.arrow", np.uint16, length=8, rows=2)
    ids = [np.arange(n, dtype=np.uint16) for n in (3, 0, 40, 1)]
    for i, x in enumerate(ids):
        w.add(i, x)
    w.close()
    r, flat = arrowfile.TokenReader(f"{tmp_path}/t.arrow"), np.concatenate(ids)
    assert r.n_valid() == 44 and r.ids(2, 30).tolist() == flat[2:32].tolist() and r.ids(0, 0).tolist() == []
    seq, mask = r.sequence(5)
    assert seq.tolist() == [*flat[40:], 0, 0, 0, 0] and mask.tolist() == [True] * 4 + [False] * 4


def test_quality_metrics(docs, rows, none):
    def brute(t):
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)

    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(docs).collect()), key=key)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).where("kept").count()


def test_quality_thresholds_follow_the_group(spark):
    rng = random.Random(2)
    common.bound_batches(spark)
    good = [(i, sentence(rng, 120), "en", f"s{i % 2}") for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in sentence(rng, 120).split(" ")), "en", "s0") for i in range(20)]
    out = quality.judge(spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string"))
    assert out.where("kept").count() == 300 and out.where("kept and doc_id >= 1000").count() == 0


def brute_removed(rows, width):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[k : k + width] for _, r in raws for k in range(len(r) - width + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - width + 1):
            if seen[r[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("most", "shard"), [(suffix.GROUP, suffix.SHARD), (900, 2000)])
def test_suffix_dedup(docs, rows, none, most, shard):
    assert sorted((tuple(r) for r in suffix.deduplicated(docs, most=most, shard=shard).collect()), key=key) == brute_removed(rows, 400)
    if most == suffix.GROUP:
        assert suffix.deduplicated(none).count() == 0


def test_trim_keeps_whole_characters(spark):
    common.bound_batches(spark)
    shared = "é" * 300
    df = spark.createDataFrame([(1, "a" + shared + "b", "x"), (2, "c" + shared, "y"), (3, None, "z")], "doc_id long, text string, spans string")
    assert {r.doc_id: r.text for r in suffix.trim(df).collect()} == {1: "ab", 2: "c", 3: None}


def test_suffix_array():
    rng = random.Random(4)
    for _ in range(150):
        s = bytes(rng.randrange(1, rng.choice([2, 3, 6, 200])) for _ in range(rng.randrange(1, 90)))
        t = np.frombuffer(s, np.uint8)
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:]) == suffix.suffix_array(t, wide=1).tolist()
        lcp = suffix.permuted_lcp(t, sa, 12)
        for x, y in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
            n = 0
            while n < 12 and x + n < len(s) and y + n < len(s) and s[x + n] == s[y + n]:
                n += 1
            assert lcp[x] == n


@pytest.mark.parametrize("wide", [1, 1 << 30])
def test_suffix_array_recurs_on_many_names(monkeypatch, wide):
    rng = random.Random(8)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    s = b" ".join(rng.choice(words) for _ in range(9000)) + b"x" * 50
    s += s[2000:9000]
    calls, whole = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda t, w: calls.append((len(t), int(t.max()) + 1)) or whole(t, w))
    assert whole(np.frombuffer(s, np.uint8), wide).tolist() == sorted(range(len(s)), key=lambda i: s[i : i + 9100])
    assert calls[0][1] > 512 and len(calls) > 1


def test_pieces_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 1000)
    rng = random.Random(9)
    raw = bytes(rng.randrange(97, 123) for _ in range(5000))
    starts = [(lo, hi) for _, lo, hi, _ in anchors.regions(raw, 400)]
    assert [k for lo, hi in starts for k in range(lo, hi + 1)] == list(range(4601))
    whole = lambda at, regions: next((h, a - at) for h, lo, hi, a in regions if lo <= at <= hi)
    assert all(whole(k, anchors.regions(raw, 400)) == whole(k + 77, anchors.regions(b"y" * 77 + raw, 400)) for k in range(0, 4601, 50))


def test_anchors_of_equal_windows_are_equal():
    rng = random.Random(6)
    shared = bytes(rng.randrange(97, 123) for _ in range(500))
    found = [anchors.regions(bytes(rng.randrange(97, 123) for _ in range(n)) + shared + b"zz", 400) for n in (11, 300)]
    at = lambda regions, start: next((h, a - start) for h, lo, hi, a in regions if lo <= start <= hi)
    assert all(at(found[0], 11 + k) == at(found[1], 300 + k) for k in range(101))


def test_chunked_bpe(docs, rows, none):
    lib = tokens.load(BYTE)
    expected = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in chunked_bpe.encoded(docs, BYTE).collect()), key=key) == sorted(expected, key=key)
    assert chunked_bpe.encoded(none, BYTE).count() == 0


def test_chunk_joins_are_repaired(monkeypatch, rows):
    monkeypatch.setattr(chunked_bpe, "CUT_BITS", 4)
    encode, lib = chunked_bpe._encoder(BYTE), tokens.load(BYTE)
    for text in [*(t or "" for _, t in rows[:45]), " " * 300, "x" * 3000, "a b " * 500, "don't 's 12 3a!!\r\n" * 90]:
        parts = [c.decode() for c in chunked_bpe.chunks(text)]
        assert "".join(parts) == text
        assert chunked_bpe.encode_text(parts, [None] * len(parts), encode) == lib.encode(text, add_special_tokens=False).ids


def auc(rows):
    good, bad = ([s for s, y in rows if y == v] for v in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(8)
    common.bound_batches(spark)
    docs, labels = [], []
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    for i in range(700):
        good, toxic = int(rng.random() < 0.7), int(rng.random() < 0.2)
        w = rng.choices(words, k=80)
        w = w if good else [x.upper() + "%%" for x in w]
        if toxic:
            for k in range(3):
                w[rng.randrange(80)] = ("grobian", "scoundrel", "blighter")[k]
        docs.append((i, " ".join(w)))
        labels.append((i, good, toxic))
    docs += [(2000, ""), (2001, None), (None, "no id"), (3, docs[3][1])]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for f, column, modulus, held in ((classify.quality, "quality", 3, 1), (classify.toxicity, "toxic", 4, 2)):
        out = f(d, y).collect()
        assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in out)
        truth = {i: (q if column == "quality" else t) for i, q, t in labels}
        assert auc([(r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]) > 0.97
        assert f(d.limit(0), y).count() == 0
        assert {round(r.score, 3) for r in f(d, y.limit(0)).collect()} == {0.5 if column == "quality" else 0.1}
    kept = classify.keep_clean(d, y)
    assert kept.columns == d.columns and 0.7 < kept.count() / len(docs) < 0.9


def test_ftrl_on_one_class():
    rows = [(1, np.array([1, 2]), np.array([0.5, 0.5]))] * 3
    assert classify.ftrl(rows)[1] == pytest.approx(np.log(3.5 / 0.5)) and classify.ftrl([])[1] == 0.0


def test_ftrl_equals_the_plain_update():
    """Against follow-the-regularised-leader written out feature by feature, over the same order of examples."""
    rng = np.random.default_rng(3)
    rows = [(int(k % 3 == 0), np.sort(rng.choice(40, 5, replace=False)), rng.random(5).astype(np.float32)) for k in range(60)]
    alpha, beta, l1, l2, scale = 0.5, 0.1, 2e-3, 1e-3, 10.0
    w_of, bias = classify.ftrl(rows, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2, scale=scale, seed=7)
    ones = sum(r[0] for r in rows)
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return -(z[f] - np.sign(z[f]) * l1) / ((beta + np.sqrt(n[f])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(rows)).tolist():
            y, fs, vs = rows[i]
            x = {**{int(f): float(v) * scale for f, v in zip(fs, vs, strict=True)}, "bias": 1.0}
            p = 1 / (1 + np.exp(-sum(weight(f) * v for f, v in x.items())))
            share = len(rows) / (2 * (ones if y else len(rows) - ones))
            for f, v in list(x.items()):
                g, old, w = (p - y) * share * v, n.get(f, 0.0), weight(f)
                z[f] = z.get(f, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / alpha * w
                n[f] = old + g * g
    assert [w_of[f] for f in range(40)] == pytest.approx([weight(f) * scale for f in range(40)], rel=1e-4, abs=1e-6)
    assert bias == pytest.approx(weight("bias") + np.log((ones + 0.5) / (len(rows) - ones + 0.5)), rel=1e-6)


def pu_risk(w, p, u, prior):
    loss = lambda g: 1 / (1 + np.exp(g))
    gp, gu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    return prior * loss(gp).mean() + max(0.0, loss(-gu).mean() - prior * loss(-gp).mean())


def test_nnpu_learns_from_nothing_and_stays_non_negative():
    rng = np.random.default_rng(4)
    p = (rng.random((60, 12)) < [0.7] * 4 + [0.05] * 8).astype(np.float32)
    u = np.vstack([(rng.random((40, 12)) < [0.7] * 4 + [0.05] * 8), (rng.random((360, 12)) < 0.03)]).astype(np.float32)
    start = np.r_[np.zeros(12), np.log(0.1 / 0.9)]
    w = classify.nnpu(p, u, 0.1, start)
    assert (w[:-1] >= 0).all() and w[:4].min() > w[4:-1].max() and pu_risk(w, p, u, 0.1) < 0.5 * pu_risk(start, p, u, 0.1)
    # The first step goes down the gradient of the plain risk, by finite differences, where its second part is positive.
    w1 = classify.nnpu(p, u, 0.1, start, epochs=1, decay=0.0)
    slope = [(pu_risk(start + 1e-5 * e, p, u, 0.1) - pu_risk(start - 1e-5 * e, p, u, 0.1)) / 2e-5 for e in np.eye(13)]
    assert all((w1[i] > start[i]) == (slope[i] < 0) or w1[i] == 0 for i in range(13))
    c = classify.calibrated(w, u, 0.1)
    assert classify.sigmoid(u @ c[:-1] + c[-1]).mean() == pytest.approx(0.1, abs=1e-6) and (c[:-1] == w[:-1]).all()


def test_training_samples_are_bounded_in_bytes(spark):
    d = spark.createDataFrame([(i, "x" * 100) for i in range(50)] + [(99, "y" * 100_000)], "doc_id long, text string")
    picked = d.selectExpr("doc_id", "1 as label")
    assert classify.sampled(d, picked).count() == 51  # long texts count like others
    some = classify.sampled(d, picked, 1000).selectExpr("sum(length(text)) as n", "count(*) as rows").first()
    assert some.n >= 1000 and some.rows < 51


def test_stages_handle_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and clashing names, through each filtering stage."""
    common.bound_batches(spark)
    rng = random.Random(11)
    passage = sentence(rng, 80)
    rows = [(i, f"{sentence(rng, 60)} {passage if i % 5 == 0 else ''} {sentence(rng, 40)}", "en", "s", "a", 1, "b") for i in range(30)]
    rows += [rows[3], (None, None, None, None, None, None, None), (50, "", None, "s", "", 0, ""), (51, sentence(rng, 40_000), "en", None, "a", 2, "c"), (52, rows[4][1], "en", "s", "a", 1, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, d int, spans string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    given = Counter(tuple(r) for r in df.collect())
    for stage in (quality.keep, lambda x: classify.keep_clean(x, labels), simhash.keep_one, lambda x: suffix.trim(x, 200)):
        out = stage(df)
        got = Counter(tuple(r) for r in out.collect())
        assert out.columns == df.columns and stage(df.limit(0)).count() == 0
        if stage is not simhash.keep_one and len(got) and out.count() == df.count() and got != given:  # the trimming stage
            texts = {r.doc_id: r.text for r in out.collect()}
            assert texts[None] is None and all(passage not in (t or "") for t in texts.values()) and len(texts[51]) == len(rows[-2][1])
            assert texts[3] == texts[4].replace(texts[4], "") == "" and texts[1] == rows[1][1]  # copies go whole
        else:
            assert not got - given
    assert {r.doc_id for r in simhash.keep_one(df).collect()} >= set(range(30)) | {51} and 52 not in {r.doc_id for r in simhash.keep_one(df).collect()}


def test_long_chunks_are_cut():
    text = "é" * 200_000 + " end"
    parts = chunked_bpe.chunks(text)
    assert b"".join(parts) == text.encode() and max(map(len, parts)) <= chunked_bpe.LONGEST + 4 and [p.decode() for p in parts]


def test_other_tokenizers_are_left_to_the_library(tmp_path):
    import json

    with open(BYTE, encoding="utf-8") as f:
        said = json.load(f)
    said["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(said, f)
    for text in ("hello world", chunked_bpe.PROBE):
        assert chunked_bpe._encoder(path)(text) == tokens.load(path).encode(text, add_special_tokens=False).ids
    assert chunked_bpe._encoder(path)("hello") != chunked_bpe._encoder(BYTE)("hello")


def test_bins_have_no_end(spark):
    values = [0, 1023, 1024, 8191, 8192, 65535, 1 << 20, (1 << 20) + 5000, 1 << 35, (1 << 44) + 12345]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bin_of(F.col("v")).alias("b")).orderBy("v").collect()]
    assert all(b <= v and v - b <= v / 64 for v, b in zip(values, got, strict=True)) and len(set(got)) >= len(values) - 1
