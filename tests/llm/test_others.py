import io
import struct

import numpy as np
import pytest
import zstandard

pytest.importorskip("kinweave.llm")

from kinweave.llm import queries, topk, warc  # noqa: E402


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(220)]
    rows += [(i, [0.5] * 6, "x") for i in range(300, 330)] + [(400, None, "x"), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (500, [float("nan")] * 6, "x"), (550, [float("inf")] * 6, "x"), (600, [1.0, 2.0], "x"), (601, [1.0, -2.0], "x"), (650, [], "x"), (None, [1.0] * 6, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3), rows


def test_top_k(spark, vectors):
    df, rows = vectors
    q = {i: np.floor(256.0 * np.array(v, float)).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    expected = []
    for i in (i for i in q if i % 50 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
        expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect()) == sorted(expected)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0 and topk.search(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_top_k_over_small_blocks_and_bins(spark, vectors, monkeypatch, block):
    df, _ = vectors
    usual = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect())
    monkeypatch.setattr(topk, "BINS", 8)
    monkeypatch.setattr(topk, "BLOCK", block)
    assert sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect()) == usual


def test_no_vectors_are_broadcast(spark, vectors, monkeypatch):
    df, _ = vectors
    plans, cut = [], topk.common.cut

    def seen(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return cut(rows)

    monkeypatch.setattr(topk.common, "cut", seen)
    found = topk.search(df, df.where("vec_id % 50 = 0"))
    assert found.collect()
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 1 and not [p for p in plans if "Broadcast" in p]


def test_top_k_in_many_parts_and_reports(spark, vectors, monkeypatch):
    df, _ = vectors
    usual = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect())
    for name, value in (("BLOCK_BYTES", 300), ("HELD", 100), ("SUMS", 1)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 50 = 0")).collect()) == usual


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [3.0e6 + 1 / 256, 1.0]), (1, [4.0e6, 1 / 256]), (2, [4.0e6, 0.0]), (3, [-4.0e6, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    best = sorted((-sum(a * b for a, b in zip(q[0], q[j], strict=True)), j) for j in q if j)
    assert sorted(tuple(r) for r in topk.search(df, df.where("vec_id = 0")).collect()) == [(0, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    wide = spark.createDataFrame([(0, [7.0e9, 7.0e9]), (1, [7.0e9, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="may not fit"):
        topk.search(wide, wide)


def test_archives(spark, tmp_path):
    big, other = "<p>" + "x" * 1200 + "é</p>", "<p>" + "y" * 1500
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (5, None, big), (2, "http://b\r\nX: y", other), (3, "http://c", "small"), (4, "http://d", "small"), (6, "u", None), (7, "u", ""), (None, "u", "n")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(2)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df, str(tmp_path / "w"))).collect()}
    n = len(big.encode())
    assert got == {1: (n, "revisit", 9), 5: (n, "revisit", 9), 9: (n, "response", None), 2: (1503, "response", None), 3: (5, "response", None), 4: (5, "response", None), 6: (0, "response", None), 7: (0, "response", None), None: (1, "response", None)}
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


def archive(records, dictionary=b"", packed=False):
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    raw = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw if dictionary else b""
    return head + b"".join(c.compress(r) for r in records)


def test_frames_with_a_dictionary_plain_or_compressed():
    records = [warc.record(i, f"http://h/{i}", b"payload %d " % i * 50, "d", None, False) for i in range(200)]
    dictionary = zstandard.train_dictionary(4096, records).as_bytes()
    for packed in (False, True):
        assert list(warc.frames(io.BytesIO(archive(records, dictionary, packed)), chunk=100)) == records
    assert list(warc.frames(io.BytesIO(archive(records)))) == records and list(warc.frames(io.BytesIO(b""))) == []
    for bad in (archive(records, dictionary)[:-5], archive(records, dictionary)[:50], b"abc"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))


def test_records_are_validated():
    import hashlib

    good = warc.record(1, "http://a", b"body", hashlib.sha1(b"body").hexdigest(), None, False)
    assert warc.parse(good)[:2] == (1, 4)
    for bad in (good[:-1], good.replace(b"body", b"bodi"), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"WARC-Date", b"WARC-Day"), good.replace(b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
